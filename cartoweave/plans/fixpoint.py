"""Fixpoints over an edge table, as rounds of joins; lineage is cut by checkpoint()."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.plans.components import ensure_checkpoint_dir


def kept(df: DataFrame) -> DataFrame:
    """df, cut off as by checkpoint(), with its partitioning, which only a plan that was made without adaptive execution keeps; so the setting is off while df is computed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    setting = "spark.sql.adaptive.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(setting, before)


def dealt(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """df, cut off, dealt and sorted by a key, to `parts` tasks if given; joins on the key don't shuffle it again.

    A key's rows stay in one task: for graphs of bounded degree.
    """
    return kept(df.repartition(*([parts] if parts else []), key).sortWithinPartitions(key))


def settle(start: DataFrame, edges: DataFrame, step: Callable[[Column], Column], on_round: Callable[[int, int], None] | None = None) -> DataFrame:
    """The least value of each node that start (node, value) and steps along edges (src, dst, ...) can reach.

    step(value) is the value at dst, from the value at src and the edge's columns; null blocks
    the way.  It must never be less than the value (breadth-first search, minimax flooding and
    cheapest paths all are like that), so the rounds end.  A value may be a struct, whose fields
    are compared in turn.  Only nodes that improved take part in the next round; edges are shuffled once.
    on_round is told each round's number, from 1, and how many nodes it improved.
    """
    ensure_checkpoint_dir(start.sparkSession)
    edges = dealt(edges, "src")
    best = start.where("value IS NOT NULL").groupBy("node").agg(F.min("value").alias("value")).checkpoint()
    front = best
    for number in count(1):
        ahead = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), step(F.col("value")).alias("new")).where("new IS NOT NULL")
        ahead = ahead.groupBy("node").agg(F.min("new").alias("new"))
        better = ahead.join(best, "node", "left").where("value IS NULL OR new < value").select("node", F.col("new").alias("value")).checkpoint()
        if on_round and (n := better.count()):
            on_round(number, n)
        if better.isEmpty():
            return best
        best = best.join(better.select("node"), "node", "left_anti").unionByName(better).checkpoint()
        front = better


def gather_downstream(flow: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, total): the sum of `amount` over the node and all that drains into it.

    flow: node, to (null or -1 for a sink), amount; a forest.  Pointer doubling: after k rounds
    a node holds the amounts of all nodes less than 2**k steps above it.
    """
    ensure_checkpoint_dir(flow.sparkSession)
    state = flow.select("node", F.nullif(F.col("to"), F.lit(-1)).alias("to"), F.col("amount").alias("total")).checkpoint()
    for _ in range(max_rounds):
        moving = state.where("to IS NOT NULL")
        if moving.isEmpty():
            return state.select("node", "total")
        gain = moving.groupBy(F.col("to").alias("node")).agg(F.sum("total").alias("gain"))
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("next"))
        state = state.join(gain, "node", "left").join(ahead, "to", "left").select("node", F.col("next").alias("to"), (F.col("total") + F.coalesce("gain", F.lit(0))).alias("total")).checkpoint()
    raise RuntimeError("the flow has a cycle")


def stems(forest: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, stem, depth): the root above each node of a forest (node, to; to is null for a root), and how many steps it is away.

    Only nodes that others hang on take part in the rounds, by pointer doubling: after k rounds those less than 2**k steps
    below their root are done.  The others are one step below one of these, and are joined once.
    """
    ensure_checkpoint_dir(forest.sparkSession)
    forest = forest.select("node", "to").checkpoint()
    inner = forest.join(forest.select(F.col("to").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_semi")
    root = F.col("to").isNull()
    state = inner.select("node", F.coalesce("to", "node").alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done")).checkpoint()
    for _ in range(max_rounds):
        climbing = state.where("NOT done")
        if climbing.isEmpty():
            break
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = climbing.join(ahead, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        state = state.where("done").unionByName(moved).checkpoint()
    else:
        raise RuntimeError("the forest has a cycle")
    below = forest.where("to IS NOT NULL").join(state.select(F.col("node").alias("to"), F.col("up").alias("stem"), "depth"), "to").select("node", "stem", (F.col("depth") + 1).alias("depth"))
    return below.unionByName(forest.where("to IS NULL").select("node", F.col("node").alias("stem"), F.lit(0).cast("long").alias("depth")))
