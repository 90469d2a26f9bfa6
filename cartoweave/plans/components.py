"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a task of a round, and pairs that a task brings to stars at once.
PAIRS, AT_ONCE = 100_000, 1 << 20


def ensure_checkpoint_dir(spark) -> None:
    """Use spark.checkpoint.dir of the session; without one choose a temporary folder, but only in local mode, where all share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="cartoweave-checkpoint-")
    sc.setCheckpointDir(where)


def _stars(batches):
    """Pairs (u, v) as stars: each node with the least node that the pairs of a piece of this partition join it to, unless it is that."""

    def star(u, v):
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v = at[: len(u)], at[len(u) :]
        least = np.arange(len(ids))
        while True:  # hooking and pointer jumping
            new = least.copy()
            np.minimum.at(new, u, least[v])
            np.minimum.at(new, v, least[u])
            while (new != new[new]).any():
                new = new[new]
            if (new == least).all():
                break
            least = new
        rest = np.flatnonzero(least != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(ids[least[rest]])], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append([b.column(c).to_numpy() for c in ("u", "v")])
        n += b.num_rows
        if n >= AT_ONCE:
            yield star(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield star(*map(np.concatenate, zip(*held, strict=True)))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return (node, component) for every node that has an edge; component is the least node reachable.

    Each task first brings its pairs to stars around their least nodes, so that a dense group is a pair a node.  Then each
    round is a large star and a small star: every node hands its neighbours to the least
    one, so the number of rounds grows with the logarithm of the number of nodes.  A hub is a
    join key like any other; the joins are plain sort-merge joins that adaptive execution can
    split.  Lineage is cut by checkpoint() in every round.  What is cut off is read again by a task for each PAIRS
    pairs, however many partitions shuffles have.  Self-loops are kept as isolated
    nodes, null ends are ignored, an empty input gives an empty result.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    given = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct().checkpoint()
    whole = given.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    tasks = lambda n: -(-n // PAIRS) or 1
    few = tasks(given.count())
    pairs = whole.coalesce(few).mapInArrow(_stars, "u long, v long").distinct().coalesce(few).checkpoint()
    both_ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")
    before = None
    while True:
        both = pairs.select(both_ways).select("p.u", "p.v")
        # cut off here, so that the join's sides come straight from shuffles, which adaptive execution can split at a hub
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(few).checkpoint()
        # large star: neighbours above the node are linked to the least of the closed neighbourhood
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the node and its neighbours below are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = small.distinct().coalesce(few).checkpoint()
        seen = pairs.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("x")).first()
        if seen == before:
            break
        before = seen
        few = tasks(seen[0])
    labels = pairs.groupBy("u").agg(F.min("v").cast(given.schema["u"].dataType).alias("m"))
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    return nodes.join(labels, nodes.node == labels.u, "left").select("node", F.least("node", F.coalesce("m", "node")).alias("component"))
