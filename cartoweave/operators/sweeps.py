"""Passes over a graph in which later cells see what earlier ones became, as sweeps over colours.

Cells of one colour have no edge between them, so all of them can be updated at once, and the colours in turn: the same as
going through the cells one by one in the order of their colours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.operators import graph
from cartoweave.plans.components import ensure_checkpoint_dir

#: Multiplier and modulus of the order in which cells are coloured.
FACTOR, MODULUS = 2654435761, 4294967296


def colours(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, colour: each cell's least colour that no neighbour before it in a scrambled order of ids has; edges (src, dst) go both ways.

    Rounds of independent sets: who comes before all its uncoloured neighbours takes its colour.  A round looks only at edges between
    uncoloured cells; what a cell's coloured neighbours have is kept as a set of bits, so colours are at most 63 (degree 62).
    """
    ensure_checkpoint_dir(cells.sparkSession)
    place = lambda c: F.struct(F.pmod(F.pmod(F.col(c), F.lit(1 << 31)) * FACTOR, F.lit(MODULUS)), F.col(c))
    open_ = cells.select("cell_id", F.lit(0).cast("long").alias("used")).checkpoint()
    ahead = edges.where("src <> dst").select("src", "dst", (place("src") < place("dst")).alias("first")).distinct().checkpoint()
    out = open_.select("cell_id", F.lit(0).alias("colour")).limit(0)
    while not open_.isEmpty():
        later = ahead.where("NOT first").select(F.col("src").alias("cell_id")).distinct()
        # used and used + 1 differ in the lowest bit that is not set and in those below it
        ones = F.col("used").bitwiseXOR(F.col("used") + 1)
        now = open_.join(later, "cell_id", "left_anti").select("cell_id", (F.bit_count(ones) - 1).cast("int").alias("colour")).checkpoint()
        out = out.union(now)
        told = ahead.join(now.withColumnRenamed("cell_id", "src"), "src").groupBy(F.col("dst").alias("cell_id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("colour"))).alias("more"))
        open_ = open_.join(now.select("cell_id"), "cell_id", "left_anti").join(told, "cell_id", "left").select("cell_id", F.col("used").bitwiseOR(F.coalesce("more", F.lit(0).cast("long"))).alias("used")).checkpoint()
        done = now.select("cell_id")
        ahead = ahead.join(done.withColumnRenamed("cell_id", "src"), "src", "left_anti").join(done.withColumnRenamed("cell_id", "dst"), "dst", "left_anti").checkpoint()
    return out


def swept(owners: DataFrame, edges: DataFrame, owner: str, coloured: DataFrame, least_adverse: int = 2, most_buddies: int = 2) -> DataFrame:
    """cell_id, owner after one pass of boundary normalisation in the order of colours: graph.vote() by classes, each seeing those before it.

    owners: cell_id, the owner, and `fixed`, true where a cell keeps its owner (a settlement, a locked state).
    An edge is read once, in the sweep of its source.
    """
    ensure_checkpoint_dir(owners.sparkSession)
    state = owners.select("cell_id", owner).checkpoint()
    free = owners.where("NOT fixed").select("cell_id").join(coloured, "cell_id")
    own = edges.join(free.withColumnRenamed("cell_id", "src"), "src").select("src", "dst", "colour").checkpoint()
    for colour in sorted(r.colour for r in own.select("colour").distinct().collect()):  # at most 63
        mine = own.where(F.col("colour") == colour)
        near = graph.neighbours(state, mine, owner).where(F.col(owner) > 0).groupBy("src", owner).agg(F.count("*").alias("n"))
        now = mine.select(F.col("src").alias("cell_id")).distinct().join(state, "cell_id").select("cell_id", F.col(owner).alias("_own"))
        votes = near.join(now, near.src == now.cell_id).groupBy("cell_id", "_own").agg(F.max(F.struct(F.col("n"), (-F.col(owner)).alias("o"))).alias("top"), F.coalesce(F.max(F.when(F.col(owner) == F.col("_own"), F.col("n"))), F.lit(0)).alias("buddies"))
        changed = votes.where((F.col("_own") > 0) & (F.col("buddies") < most_buddies) & (F.col("top.n") >= least_adverse) & (-F.col("top.o") != F.col("_own"))).select("cell_id", (-F.col("top.o")).alias("_new"))
        state = state.join(changed, "cell_id", "left").select("cell_id", F.coalesce("_new", owner).alias(owner)).checkpoint()
    return state
