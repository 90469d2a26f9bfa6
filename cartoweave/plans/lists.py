"""Order along linked rings, by pointer doubling: logarithmic rounds, whatever the length of a ring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.plans.components import ensure_checkpoint_dir


def rings(links: DataFrame) -> DataFrame:
    """(node, head, place): the least node of each node's ring, and the steps from there.

    links: node, next; every node has one next and is the next of one.  After k rounds a node has seen
    2**k nodes: first all look for the least one, then all but the least count their way back to it.
    Each join brings together one row with one, so no ring and no node is a hot key.
    """
    ensure_checkpoint_dir(links.sparkSession)
    links = links.select("node", "next").checkpoint()
    state = links.withColumn("head", F.col("node"))
    while True:
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("head").alias("_head"))
        moved = state.join(ahead, "next").select("node", F.col("_next").alias("next"), F.least("head", "_head").alias("head"), (F.col("_head") < F.col("head")).alias("less")).checkpoint()
        state = moved.drop("less")
        if moved.where("less").isEmpty():
            break
    heads = state.select("node", "head")
    back = links.select(F.col("next").alias("node"), F.col("node").alias("prev")).join(heads, "node")
    first = F.col("node") == F.col("head")
    state = back.select("node", "head", F.when(~first, F.col("prev")).alias("prev"), F.when(first, 0).otherwise(1).cast("long").alias("place")).checkpoint()
    while not state.where("prev IS NOT NULL").isEmpty():
        behind = state.select(F.col("node").alias("prev"), F.col("prev").alias("_prev"), F.col("place").alias("_place"))
        state = state.join(behind, "prev", "left").select("node", "head", F.col("_prev").alias("prev"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")).checkpoint()
    return state.select("node", "head", "place")
