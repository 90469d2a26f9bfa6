"""Places in a total order, by ranges and offsets instead of a window over one partition."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.plans.components import ensure_checkpoint_dir


def ranked(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their place, from 1, in the order, which must not have ties.

    Rows are dealt by range and sorted within each; a place is the row's number in its range
    plus the sizes of the ranges before, one number a range.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    # the upper bits are the range, the lower 33 the row's number in it; cut off here, as ranges are sampled anew by every run
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, place).drop("_at", "_range", "_before")
