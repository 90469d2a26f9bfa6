"""Watersheds, and flooding by contracting them: logarithmic rounds in place of the map's diameter.

Every cell points to its lowest neighbour, if that is lower (of equal heights the lesser id is lower); cells at the
map's border drain off it.  What points to one pit is a basin, whose name is the pit; all that drains off the
map is basin OUT.  Between two basins the lowest pair of neighbouring cells is the pass.  In each round every
group of basins takes its lowest pass (Boruvka), and groups that passes join become one.  A basin's level is the highest of the passes
that its group took until it met OUT, which is the height of the lowest way off the map.  The passes that were
taken are a tree, the least spanning tree of the basins; seen from OUT it says where each lake spills.

cells: cell_id (0 or more), height, is_border; edges: src, dst, both directions.  Basins that no way leads out of
have level null and no parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.operators.graph import neighbours
from cartoweave.plans import blocks
from cartoweave.plans.components import ensure_checkpoint_dir

OUT = -1


def basins(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, height, basin."""
    low = neighbours(cells.select("cell_id", "height"), edges, "height").groupBy(F.col("src").alias("cell_id")).agg(F.min(F.struct("height", "dst")).alias("_low"))
    c = cells.select("cell_id", "height", "is_border").join(low, "cell_id", "left")
    down = ~F.col("is_border") & (F.struct(F.col("_low.height").alias("h"), F.col("_low.dst").alias("i")) < F.struct(F.col("height").alias("h"), F.col("cell_id").alias("i")))
    c = c.select("cell_id", "height", "is_border", F.when(down, F.col("_low.dst")).alias("to")).checkpoint()
    parts = blocks.joined(c.where("to IS NOT NULL").select(F.col("cell_id").alias("src"), F.col("to").alias("dst")))
    named = c.join(parts, c.cell_id == parts.node, "left").withColumn("component", F.coalesce("component", "cell_id"))
    # the one cell of a component that points nowhere is its pit, or where it leaves the map
    pits = named.where("to IS NULL").select("component", F.when(F.col("is_border"), OUT).otherwise(F.col("cell_id")).cast("long").alias("basin"))
    return named.join(pits, "component").select("cell_id", "height", "basin")


def passes(basins_: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, pass (height, lo, hi, u, v): of each two neighbouring basins, in both directions, the lowest way from u in a to v in b."""
    b = basins_.select("cell_id", F.col("height").alias("h"), "basin")
    over = edges.join(b.select(F.col("cell_id").alias("src"), F.col("h").alias("h1"), F.col("basin").alias("a")), "src")
    over = over.join(b.select(F.col("cell_id").alias("dst"), F.col("h").alias("h2"), F.col("basin").alias("b")), "dst").where("a <> b")
    way = F.struct(F.greatest("h1", "h2").alias("height"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.col("src").alias("u"), F.col("dst").alias("v"))
    return over.groupBy("a", "b").agg(F.min(way).alias("pass"))


def contracted(passes_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(basin, level) and the tree's passes (a, b, pass), each in one of its directions."""
    ensure_checkpoint_dir(passes_.sparkSession)
    left = passes_.select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.struct("pass.height", "pass.lo", "pass.hi", "pass.u", "pass.v", "a", "b").alias("way")).checkpoint()
    groups = left.select(F.col("ga").alias("basin")).distinct().select("basin", F.col("basin").alias("group"), F.lit(None).cast("double").alias("level")).checkpoint()
    tree = None
    while True:
        picks = left.where(F.col("ga") != OUT).groupBy("ga").agg(F.min(F.struct("way", "gb")).alias("p")).select("ga", "p.gb", "p.way").checkpoint()
        if picks.isEmpty():
            break
        taken = picks.select("way.a", "way.b", F.struct("way.height", "way.lo", "way.hi", "way.u", "way.v").alias("pass"))
        tree = taken if tree is None else tree.unionByName(taken)
        joined = blocks.joined(picks.select(F.col("ga").alias("src"), F.col("gb").alias("dst"))).select(F.col("node").alias("group"), "component").checkpoint()  # OUT is the least
        high = picks.select(F.col("ga").alias("group"), F.col("way.height").cast("double").alias("_h"))
        groups = groups.join(high, "group", "left").join(joined, "group", "left").select("basin", F.coalesce("component", "group").alias("group"), F.greatest("level", "_h").alias("level")).checkpoint()
        for end in ("ga", "gb"):
            left = left.join(joined.withColumnRenamed("group", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        left = left.where("ga <> gb").groupBy("ga", "gb").agg(F.min("way").alias("way")).checkpoint()
    levels = groups.where(F.col("basin") != OUT).select("basin", F.when(F.col("group") == OUT, F.col("level")).alias("level"))
    if tree is None:
        tree = passes_.limit(0)
    # a pass that both of its sides took is one
    return levels, tree.groupBy(F.col("pass.lo").alias("_lo"), F.col("pass.hi").alias("_hi")).agg(F.min(F.struct("a", "b", "pass")).alias("p")).select("p.*")


def filled(basins_: DataFrame, levels: DataFrame) -> DataFrame:
    """cell_id, filled: the height, or its basin's level where that is higher; the same as graph.flood()."""
    kind = basins_.schema["height"].dataType
    return basins_.join(levels, "basin", "left").select("cell_id", F.greatest("height", F.col("level").cast(kind)).alias("filled"))


def lake_tree(levels: DataFrame, tree: DataFrame) -> DataFrame:
    """lake, parent, pass_height, outlet, beyond, level: where each basin spills on its way off the map; outlet is its own cell at the pass, beyond the parent's.

    Parents come from the tree's steps to OUT, which is block-synchronous.
    """
    ensure_checkpoint_dir(levels.sparkSession)
    tree = tree.checkpoint()
    other = tree.select(F.col("b").alias("a"), F.col("a").alias("b"), F.struct(F.col("pass.height"), F.col("pass.lo"), F.col("pass.hi"), F.col("pass.v").alias("u"), F.col("pass.u").alias("v")).alias("pass"))
    both = tree.unionByName(other)
    start = levels.sparkSession.createDataFrame([(OUT, 0.0)], "node long, value double")
    steps = blocks.settle(start, both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("w"))).select("node", "value").checkpoint()
    up = both.join(steps.select(F.col("node").alias("a"), F.col("value").alias("_a")), "a").join(steps.select(F.col("node").alias("b"), F.col("value").alias("_b")), "b").where("_b < _a")
    return levels.join(up.select(F.col("a").alias("basin"), F.col("b").alias("parent"), "pass"), "basin", "left").select(F.col("basin").alias("lake"), "parent", F.col("pass.height").cast("double").alias("pass_height"), F.col("pass.u").alias("outlet"), F.col("pass.v").alias("beyond"), "level")


def lake_flux(basins_: DataFrame, tree: DataFrame, rain: DataFrame) -> DataFrame:
    """lake, own, total: the rain (cell_id, precip) on each basin, and with all that spills into it; OUT has what leaves the map.

    tree: from lake_tree().  Nothing is lost: OUT's total is all rain on cells that have a way out.
    """
    own = basins_.join(rain, "cell_id").groupBy("basin").agg(F.sum("precip").cast("long").alias("own"))
    to = own.join(tree.select(F.col("lake").alias("basin"), "parent"), "basin", "left").select(F.col("basin").alias("node"), "parent", "own").checkpoint()
    # OUT is node 0 here, as sinks are marked by -1
    flow = to.select((F.col("node") + 1).alias("node"), F.when(F.col("node") != OUT, F.col("parent") + 1).alias("to"), F.col("own").alias("amount"))
    missing = flow.where("to = 0").select("to").distinct().join(flow.select(F.col("node").alias("to")), "to", "left_anti").select(F.col("to").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(0).cast("long").alias("amount"))
    total = blocks.gathered(flow.unionByName(missing)).select((F.col("node") - 1).alias("node"), "total")
    return total.join(to, "node", "left").select(F.col("node").alias("lake"), F.coalesce("own", F.lit(0).cast("long")).alias("own"), "total")
