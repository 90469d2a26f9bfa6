"""Operators on the graph of cells: neighbour aggregates, regions, distances, flooding, drainage, expansion.

Tables: cells (cell_id, height, ...), edges (src, dst; both directions).  Everything is a join,
a fixpoint of joins, or a block-synchronous computation (plans.blocks), at any size.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoweave.plans import blocks
from cartoweave.plans.components import ensure_checkpoint_dir
from cartoweave.plans.fixpoint import dealt, kept, settle

SEA = 20
#: Places of a line that a wind folds in one row.
SEGMENT = 256
#: Changed segments that are broadcast to all, a few dozen bytes each; more are joined by a shuffle.
CHANGED = 50_000
#: Edges of a task of a round of expand_by_owner(), tasks of a small graph, and rounds after which what improved is merged.
SIDES, FEWEST, MERGED = 200_000, 8, 8


def neighbours(cells: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """(src, dst, columns of dst)."""
    n = cells.select(F.col("cell_id").alias("dst"), *columns)
    return edges.join(n, "dst").select("src", "dst", *columns)


def neighbour_agg(cells: DataFrame, edges: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    """cells with aggregates over each cell's neighbours; null where it has none."""
    found = neighbours(cells, edges, *columns).groupBy(F.col("src").alias("cell_id")).agg(*aggregates)
    return cells.join(found, "cell_id", "left")


def smooth(cells: DataFrame, edges: DataFrame, factor: float = 2.0, add: float = 0.0) -> DataFrame:
    """cell_id and the height moved towards the mean of the cell and its neighbours, between 0 and 100."""
    near = neighbour_agg(cells.select("cell_id", "height"), edges, ["height"], F.sum(F.col("height").cast("double")).alias("s"), F.count("*").alias("n"))
    mean = (F.col("height") + F.coalesce("s", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))
    new = mean + add if factor == 1 else (F.col("height") * (factor - 1) + mean + add) / factor
    return near.select("cell_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), new)).alias("height"))


def regions(cells: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """cell_id, kind, region: connected cells of one kind; a region is named by its least cell."""
    c = cells.select("cell_id", F.col(kind).alias("kind"))
    other = c.select(F.col("cell_id").alias("dst"), F.col("kind").alias("k2"))
    inside = edges.join(c, edges.src == c.cell_id).join(other, "dst").where(F.col("kind").eqNullSafe(F.col("k2"))).select("src", "dst")
    found = blocks.joined(inside)
    return c.join(found, c.cell_id == found.node, "left").select("cell_id", "kind", F.coalesce("component", "cell_id").alias("region"))


def features(cells: DataFrame, regions_: DataFrame, border: str = "is_border") -> DataFrame:
    """region, kind (ocean, lake, island), n_cells, touches_border, first_cell: water at the border is ocean."""
    f = regions_.join(cells.select("cell_id", F.col(border).alias("_b"), "height"), "cell_id").groupBy("region").agg(F.count("*").alias("n_cells"), F.bool_or("_b").alias("touches_border"), F.min("cell_id").alias("first_cell"), F.bool_or(F.col("height") >= SEA).alias("land"))
    return f.select("region", F.when(F.col("land"), "island").when(F.col("touches_border"), "ocean").otherwise("lake").alias("feature"), "n_cells", "touches_border", "first_cell")


def distance_field(cells: DataFrame, edges: DataFrame, lowest: int = -10, on_round=None) -> DataFrame:
    """cell_id, distance: 1, 2, ... inland from the coast, -1 ... lowest out to sea; 0 beyond, or without a coast.

    With on_round, as in fixpoint.settle(), cells are settled ring by ring and not by blocks.
    """
    c = cells.select("cell_id", (F.col("height") >= SEA).alias("land"))
    other = c.select(F.col("cell_id").alias("dst"), F.col("land").alias("land2"))
    sides = edges.join(c, edges.src == c.cell_id).join(other, "dst")
    coast = sides.where("land <> land2").select(F.col("src").alias("node"), F.lit(1).alias("value"))
    inside = sides.where("land = land2").select("src", "dst", "land")
    if on_round:
        reach = settle(coast, inside, lambda v: F.when(F.col("land") | (v < -lowest), v + 1), on_round)
    else:
        reach = blocks.settle(coast, inside.select("src", "dst", F.lit(1).alias("w"), F.when(~F.col("land"), -lowest).alias("cap")))
    return c.join(reach, c.cell_id == reach.node, "left").select("cell_id", F.coalesce(F.when(F.col("land"), F.col("value")).otherwise(-F.col("value")), F.lit(0)).cast("long").alias("distance"))


def flood(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, filled: the least height at which water from the cell can reach the border (minimax paths)."""
    start = cells.where("is_border").select(F.col("cell_id").alias("node"), F.col("height").alias("value"))
    filled = blocks.settle(start, neighbours(cells, edges, "height").withColumnRenamed("height", "w"), "max")
    own = F.col("value").cast(cells.schema["height"].dataType)
    return cells.select("cell_id", "height").join(filled, F.col("cell_id") == F.col("node"), "left").select("cell_id", F.coalesce(own, "height").alias("filled"))


def flow_direction(filled: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, to: the lowest neighbour that is strictly lower, on ties the least cell; -1 at a sink."""
    c = filled.select("cell_id", F.col("filled").alias("height"))
    n = neighbours(c, edges, "height").groupBy(F.col("src").alias("cell_id")).agg(F.min(F.struct(F.col("height").alias("h"), F.col("dst").alias("d"))).alias("low"))
    return c.join(n, "cell_id", "left").select("cell_id", F.when(F.col("low.h") < F.col("height"), F.col("low.d")).otherwise(-1).alias("to"))


def accumulate(flow: DataFrame, amount: DataFrame) -> DataFrame:
    """cell_id, flux: amount (cell_id, precip) of the cell and of all that flows into it."""
    rows = flow.join(amount, "cell_id").select(F.col("cell_id").alias("node"), "to", F.col("precip").alias("amount"))
    return blocks.gathered(rows).select(F.col("node").alias("cell_id"), F.col("total").alias("flux"))


def altered(cells: DataFrame, distance: DataFrame, edges: DataFrame) -> DataFrame:
    """cells, with land raised a little by its distance from the coast and by its neighbours', so that flat land drains."""
    near = neighbours(distance, edges, "distance").groupBy(F.col("src").alias("cell_id")).agg(F.avg("distance").alias("_mean"))
    up = F.when(F.col("height") >= SEA, F.col("distance") / 100.0 + F.coalesce("_mean", F.lit(0.0)) / 10000.0).otherwise(0.0)
    return cells.join(distance, "cell_id").join(near, "cell_id", "left").withColumn("height", F.col("height") + up).select(*cells.columns)


def lake_kind() -> Column:
    """What joins the cells of a lake: their level, if they are under water."""
    return F.when((F.col("flux") > 0) & (F.col("filled") > F.col("height")), F.col("filled")).otherwise(-1)


def lakes(drained: DataFrame, regions_: DataFrame, edges: DataFrame, flux: int = 15, least: int = 3) -> DataFrame:
    """lake (its least cell), level, n_cells, outlet, shore: connected flooded cells of one level around a sink, of `least` cells or more.

    drained: cell_id, height, is_border, filled, to, flux; regions_: regions by lake_kind().  The
    outlet is the lowest of its cells with a neighbour outside of the lake, ties to the lesser cell;
    shore is the least height next to the lake.
    """
    r = regions_.select("cell_id", "region")
    sink = (F.col("to") == -1) & (F.col("flux") > flux) & ~F.col("is_border") & (F.col("filled") > F.col("height"))
    found = drained.join(r, "cell_id").groupBy("region").agg(F.first("filled").cast("long").alias("level"), F.count("*").alias("n_cells"), F.bool_or(sink).alias("_sink")).where((F.col("n_cells") >= least) & F.col("_sink"))
    around = r.withColumnRenamed("region", "_other").join(drained.select("cell_id", F.col("height").alias("_beyond")), "cell_id")
    rim = neighbours(around, edges, "_other", "_beyond").join(r, F.col("src") == F.col("cell_id")).where("region <> _other")
    outlets = rim.join(drained.select("cell_id", "height"), "cell_id").groupBy("region").agg(F.min(F.struct("height", "cell_id")).alias("_low"), F.min("_beyond").cast("long").alias("shore"))
    return found.join(outlets, "region", "left").select(F.col("region").alias("lake"), "level", "n_cells", F.col("_low.cell_id").alias("outlet"), "shore")


def rivers(flow: DataFrame, flux: DataFrame, threshold: int, least: int = 1) -> DataFrame:
    """cell_id, river_id, parent_id: cells of at least threshold flux, of rivers with `least` cells or more.

    A river begins where no such cell flows in.  Where rivers meet, the one with the larger
    inflow (on ties the lesser cell) goes on, and the others end with it as their parent.
    """
    big = flux.where(F.col("flux") >= threshold)
    steps = flow.join(big, "cell_id").select("cell_id", "to", "flux")
    into = steps.where("to >= 0").select(F.col("to").alias("cell_id"), F.struct(-F.col("flux"), F.col("cell_id")).alias("rank"), F.col("cell_id").alias("above"))
    w = Window.partitionBy("cell_id").orderBy("rank")
    main = into.withColumn("n", F.row_number().over(w)).where("n = 1").select("cell_id", F.col("above").alias("above"))
    heads = steps.join(main, "cell_id", "left")
    # a cell without a main inflow starts a river; others belong to the river of their main inflow
    start = heads.where("above IS NULL").select(F.col("cell_id").alias("node"), F.lit(0).alias("value"), F.col("cell_id").alias("owner"))
    down = main.select(F.col("above").alias("src"), F.col("cell_id").alias("dst"), F.lit(0).alias("w"))
    named = blocks.settle(start, down).select(F.col("node").alias("cell_id"), F.col("owner").alias("river_id"))
    last = steps.join(named, "cell_id").join(main.select(F.col("cell_id").alias("to"), F.col("above").alias("keeps")), "to", "left")
    ends = last.where("keeps IS NULL OR keeps <> cell_id").join(named.select(F.col("cell_id").alias("to"), F.col("river_id").alias("parent_id")), "to", "left").select("river_id", "parent_id")
    if least > 1:
        long_ = named.groupBy("river_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("river_id")
        named = named.join(long_, "river_id", "left_semi")
        # a river that is dropped is nobody's parent
        ends = ends.join(long_.select(F.col("river_id").alias("_kept")), F.col("parent_id") == F.col("_kept"), "left").select("river_id", F.col("_kept").alias("parent_id"))
    return named.join(ends, "river_id", "left").select("cell_id", "river_id", "parent_id")


def expand(seeds: DataFrame, costs: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """cell_id, cost, owner: every cell goes to the owner that reaches it most cheaply, ties to the lesser owner.

    seeds: cell_id, owner; costs: cell_id, cost (whole number, null where nobody can go).
    """
    start = seeds.select(F.col("cell_id").alias("node"), F.lit(0).alias("value"), "owner")
    ahead = neighbours(costs, edges, "cost").where("cost IS NOT NULL").select("src", "dst", F.col("cost").alias("w"), F.lit(limit).alias("cap"))
    best = blocks.settle(start, ahead)
    return best.select(F.col("node").alias("cell_id"), F.col("value").cast("long").alias("cost"), "owner")


def expand_by_owner(seeds: DataFrame, cells: DataFrame, edges: DataFrame, cost: Column, limit: float) -> DataFrame:
    """cell_id, cost, owner as by expand(), but each owner has costs of its own.

    seeds: cell_id, owner (one row an owner) and columns of the owner; cells: cell_id and columns
    of the cell; cost: of entering a cell, from both and from other columns of edges, at least 0, null where the owner can't go.
    Each owner's cheapest paths are settled on their own, up to the limit; nobody enters the seed of another.
    """
    parts = max(FEWEST, -(-edges.count() // SIDES))
    who = dealt(seeds.drop("cell_id"), "owner", parts)
    centre = seeds.select(F.col("cell_id").alias("dst"), F.lit(True).alias("_seed")).distinct()
    ahead = edges.join(cells.withColumnRenamed("cell_id", "dst"), "dst").join(centre, "dst", "left").where("_seed IS NULL").drop("_seed")
    ahead = dealt(ahead, "src", parts)
    # what is known is dealt by cells and never shuffled again: a round shuffles its steps, and writes what improved
    known = front = dealt(seeds.select("cell_id", "owner", F.lit(0.0).alias("value")), "cell_id", parts)
    none = F.lit(None).cast("double")
    for number in count(1):
        step = front.join(ahead, front.cell_id == ahead.src).drop("cell_id").repartition(parts, "owner").join(who, "owner").select(F.col("dst").alias("cell_id"), "owner", (F.col("value") + cost).alias("new"))
        step = step.where(F.col("new") <= limit).repartition(parts, "cell_id").select("cell_id", "owner", none.alias("value"), "new")
        both = known.select("cell_id", "owner", "value", none.alias("new")).unionByName(step).groupBy("cell_id", "owner").agg(F.min("value").alias("value"), F.min("new").alias("new"))
        front = kept(both.where("new IS NOT NULL AND (value IS NULL OR new < value)").select("cell_id", "owner", F.col("new").alias("value")))
        if front.isEmpty():
            least = known.groupBy("cell_id").agg(F.min(F.struct("value", "owner")).alias("_least"))
            return least.select("cell_id", F.col("_least.value").alias("cost"), F.col("_least.owner").cast("long").alias("owner"))
        known = known.unionByName(front)
        if number % MERGED == 0:
            known = kept(known.groupBy("cell_id", "owner").agg(F.min("value").alias("value")))


def vote(owners: DataFrame, edges: DataFrame, owner: str, least_adverse: int = 2, most_buddies: int = 2) -> DataFrame:
    """One synchronous pass of boundary normalisation: a cell with too few friends goes to the strongest neighbouring owner."""
    near = neighbours(owners, edges, owner).where(F.col(owner) > 0).groupBy("src", owner).agg(F.count("*").alias("n"))
    top = near.groupBy(F.col("src").alias("cell_id")).agg(F.max(F.struct(F.col("n"), (-F.col(owner)).alias("o"))).alias("top"))
    mine = near.select(F.col("src").alias("cell_id"), F.col(owner).alias("_own"), F.col("n").alias("buddies"))
    c = owners.join(top, "cell_id", "left").join(mine, (owners.cell_id == mine.cell_id) & (owners[owner] == mine._own), "left").drop(mine.cell_id)
    weak = (F.col(owner) > 0) & (F.coalesce("buddies", F.lit(0)) < most_buddies) & (F.col("top.n") >= least_adverse)
    return c.select(owners.cell_id, F.when(weak, -F.col("top.o")).otherwise(F.col(owner)).alias(owner))


def absorb_small(owners: DataFrame, edges: DataFrame, owner: str, least: int) -> DataFrame:
    """Cells of owners with fewer than `least` cells go to the commonest large owner next to them, else to nobody."""
    sizes = owners.where(F.col(owner) > 0).groupBy(owner).agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") >= least).select(F.col(owner).alias("_large"))
    near = neighbours(owners, edges, owner).join(large, F.col(owner) == F.col("_large")).groupBy("src", owner).agg(F.count("*").alias("n"))
    top = near.groupBy(F.col("src").alias("_cell")).agg(F.max(F.struct("n", (-F.col(owner)).alias("o"))).alias("top"))
    c = owners.join(large, F.col(owner) == F.col("_large"), "left").join(top, F.col("cell_id") == F.col("_cell"), "left")
    return c.select("cell_id", F.when((F.col(owner) == 0) | F.col("_large").isNotNull(), F.col(owner)).otherwise(F.coalesce(-F.col("top.o"), F.lit(0))).alias(owner))


def deep_lakes(cells: DataFrame, edges: DataFrame, depth: int = 20) -> DataFrame:
    """cell_id, level: land from which every way to water climbs at least `depth`; level is the height of that pass."""
    start = cells.where(F.col("height") < SEA).select(F.col("cell_id").alias("node"), F.col("height").alias("value"))
    reach = blocks.settle(start, neighbours(cells, edges, "height").withColumnRenamed("height", "w"), "max")
    c = cells.where(F.col("height") >= SEA).select("cell_id", "height").join(reach, F.col("cell_id") == F.col("node"))
    return c.where(F.col("value") - F.col("height") >= depth).select("cell_id", F.col("value").cast("long").alias("level"))


def breached(cells: DataFrame, edges: DataFrame, features_: DataFrame, regions_: DataFrame, most: int = 22) -> DataFrame:
    """cell_id, lake: for each lake the least land cell of at most `most` between it and the ocean, which opens it to the sea."""
    kind = regions_.join(features_.select("region", "feature"), "region").select(F.col("cell_id").alias("dst"), "region", "feature")
    low = cells.where(F.col("height").between(SEA, most)).select(F.col("cell_id").alias("src"))
    sides = edges.join(low, "src").join(kind, "dst")
    lakes, ocean = sides.where("feature = 'lake'").select("src", F.col("region").alias("lake")), sides.where("feature = 'ocean'").select("src").distinct()
    return lakes.join(ocean, "src", "left_semi").groupBy("lake").agg(F.min("src").alias("cell_id")).select("cell_id", "lake")


#: Humidity gained and rain left on each step over water; above PEAK no air passes; a step's share of humidity on land; a coast's.
GAIN, PEAK, LAND, COAST = 5, 85, 10, 15


def wind(lines: DataFrame, frozen: int = -5, segment: int = SEGMENT) -> DataFrame:
    """cell_id, rain of a wind along each line: lines has line, place (from 0 on), cell_id, height, temperature, strength.

    Humidity, which is the line's strength less its first height, is carried from cell to cell; over
    water it grows, on the last water before land rain falls on the land, on land it falls, more so
    on slopes, and at a peak or the end of the line wholly.  Cells colder than `frozen` are passed
    over.  A line of any length is cut into segments of so many places, each one row.  In a round each segment whose
    entry changed is folded, and tells the next what comes out; all begin with what the line begins with.  As
    water fills the air and peaks empty it, few changes go far, and a line of k segments takes k rounds at most.
    Segments that all air passes unchanged, as those of a frozen pole, are left out, so no change goes through them round by round.
    Cells that no rain falls on have no row; a cell that rain falls on twice has two.
    """
    cell = F.struct("place", "cell_id", F.col("height").cast("double").alias("h"), (F.col("temperature") < frozen).alias("cold"), F.col("strength").cast("double").alias("most"))
    ensure_checkpoint_dir(lines.sparkSession)
    cut = lines.groupBy("line", F.floor(F.col("place") / segment).alias("seg")).agg(F.array_sort(F.collect_list(cell)).alias("c")).checkpoint()
    w = Window.partitionBy("line").orderBy("seg")
    head = F.get("c", F.lit(0))
    # heads alone go through the window: a row a segment
    heads = cut.select("line", "seg", head.alias("head")).select("line", "seg", F.lead("seg").over(w).alias("next"), F.lead("head").over(w).alias("after"), F.first("head").over(w).alias("first"))
    air = F.col("first.most") - F.col("first.h")
    entry = heads.select("line", "seg", F.when(air > 0, air).otherwise(-1.0).alias("air"))
    # each cell with its successor, null at the line's end, but for those that the air passes as it is
    pairs = F.zip_with("c", F.concat(F.slice("c", F.lit(2), F.size("c")), F.array("after")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    passed = lambda e: F.coalesce(e["a"]["cold"] | ((e["a"]["h"] < SEA) & e["b"].isNull()), F.lit(False))
    rows = cut.join(heads.select("line", "seg", "after"), ["line", "seg"]).select("line", "seg", F.filter(pairs, lambda e: ~passed(e)).alias("c")).where(F.size("c") > 0).checkpoint()
    entry = entry.join(rows.select("line", "seg"), ["line", "seg"]).withColumn("next", F.lead("seg").over(w)).checkpoint()

    def step(s, e, write=True):
        a, b, air = e["a"], e["b"], s["air"]
        rise, slope = F.greatest(b["h"] - a["h"], F.lit(0.0)), b["h"] / 70
        fall = F.when(b["h"] > PEAK, air).otherwise(F.least(F.greatest(air / LAND, F.lit(1.0)) + rise * (slope * slope), air))
        left = F.when(b["h"] > PEAK, 0.0).otherwise(F.greatest(air - fall + F.when(fall > 1.5, 1.0).otherwise(0.0), F.lit(0.0)))
        wet = a["h"] < SEA
        idle = (s["air"] < 0) | a["cold"] | (wet & b.isNull())
        coast = wet & (b["h"] >= SEA)
        new = F.when(idle | coast, air).when(wet, F.least(air + GAIN, a["most"])).when(b.isNull(), 0.0).otherwise(left)
        if not write:
            return F.struct(new.alias("air"))
        amount = F.when(coast, F.greatest(air / COAST, F.lit(1.0))).when(wet, float(GAIN)).when(b.isNull(), air).otherwise(fall)
        drop = F.struct(F.when(coast, b["cell_id"]).otherwise(a["cell_id"]).alias("cell_id"), F.floor(amount).cast("long").alias("rain"))
        return F.struct(new.alias("air"), F.when(idle, s["out"]).otherwise(F.concat(s["out"], F.array(drop))).alias("out"))

    changed = entry
    while True:
        moving = changed.where("next IS NOT NULL")
        told = rows.join(F.broadcast(moving) if moving.count() <= CHANGED else moving, ["line", "seg"]).select("line", F.col("next").alias("seg"), F.aggregate("c", F.struct(F.col("air").alias("air")), lambda s, e: step(s, e, False), lambda s: s["air"]).alias("told"))
        changed = told.join(entry, ["line", "seg"]).where("told <> air").select("line", "seg", F.col("told").alias("air"), "next").checkpoint()
        if changed.isEmpty():
            break
        entry = entry.join(changed.select("line", "seg"), ["line", "seg"], "left_anti").unionByName(changed).checkpoint()
    start = F.struct(F.col("air").alias("air"), F.array().cast("array<struct<cell_id:long,rain:long>>").alias("out"))
    fallen = rows.join(entry, ["line", "seg"]).select(F.explode(F.aggregate("c", start, lambda s, e: step(s, e), lambda s: s["out"])).alias("r"))
    return fallen.select("r.cell_id", "r.rain").where("rain > 0")
