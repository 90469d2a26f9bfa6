"""Choice of points by rank with a least distance, by squares and without pairs of candidates.

A square's diagonal is just under the radius, so of a square one point is taken at most, and only the 24 squares
around can hold others that are too near.  In a round each square names its best live candidate; who is better than
the best of all squares around is taken, and live candidates nearer than the radius to those taken are out.
This gives what going through all in order of rank (ties: the lesser id) gives.  What is compared is a row a square, not a row a pair, and each
live candidate meets 25 taken points at the most.  Candidates without rank or place are never taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.functions import geometry as G
from cartoweave.plans.components import ensure_checkpoint_dir

#: Side of a square over the radius (less than 1 / sqrt(2)), and rows of taken points that are broadcast.
SIDE, FEW = 0.7071, 1_000_000


def _squares(rows: DataFrame, radius: float) -> DataFrame:
    return rows.withColumns({"_i": F.floor(F.col("x") / (radius * SIDE)), "_j": F.floor(F.col("y") / (radius * SIDE))})


def _spread(rows: DataFrame) -> DataFrame:
    """Rows copied to the 5 x 5 squares around theirs."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    return rows.withColumn("_s", F.explode(steps)).withColumns({"_i": F.col("_i") + F.col("_s.a"), "_j": F.col("_j") + F.col("_s.b"), "_own": (F.col("_s.a") == 0) & (F.col("_s.b") == 0)}).drop("_s")


def _far(live: DataFrame, taken: DataFrame, radius: float) -> DataFrame:
    """Live rows that are at least the radius from all taken points (x, y, with their squares)."""
    near = _spread(taken.select("x", "y", "_i", "_j")).select(F.col("_i").alias("_ti"), F.col("_j").alias("_tj"), F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    near = F.broadcast(near) if taken.count() * 25 <= FEW else near
    too_near = G.distance(F.col("x"), F.col("y"), F.col("_tx"), F.col("_ty")) < radius
    return live.join(near, (F.col("_i") == F.col("_ti")) & (F.col("_j") == F.col("_tj")) & too_near, "left_anti")


def spaced(candidates: DataFrame, radius: float, among: DataFrame | None = None) -> DataFrame:
    """The candidates (id, x, y, rank) taken greedily, each at least radius from all better ones that are taken and from all points (x, y) of among."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    ensure_checkpoint_dir(candidates.sparkSession)
    live = _squares(candidates.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "rank").dropna(), radius)
    if among is not None:
        live = _far(live, _squares(among.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), radius).distinct(), radius)
    live = live.checkpoint()
    taken = live.select("id").limit(0)
    while not live.isEmpty():
        best = live.groupBy("_i", "_j").agg(F.min(F.struct("rank", "id", "x", "y")).alias("b"))
        # the best of a square next to the best of the squares around it, in one aggregation
        met = _spread(best).groupBy("_i", "_j").agg(F.max(F.when(F.col("_own"), F.col("b"))).alias("b"), F.min(F.when(~F.col("_own"), F.struct("b.rank", "b.id"))).alias("around"))
        new = met.where(F.col("b").isNotNull() & (F.col("around").isNull() | (F.struct("b.rank", "b.id") < F.col("around")))).select("b.id", "b.x", "b.y", "_i", "_j").checkpoint()
        taken = taken.union(new.select("id"))
        live = _far(live, new, radius).checkpoint()
    return candidates.join(taken, "id", "left_semi")


def spaced_enough(candidates: DataFrame, radius: float, wanted: int, shrink: float = 1.2, tries: int = 3, among: DataFrame | None = None) -> tuple[DataFrame, float]:
    """The first `wanted` of spaced() by rank, and the last radius: while there are fewer, those taken stay and the search goes on with the radius divided by `shrink`, `tries` times at most."""
    taken = candidates.limit(0)
    for left in range(tries, -1, -1):
        kept = taken.select("x", "y") if among is None else taken.select("x", "y").union(among.select("x", "y"))
        rest = candidates.join(taken.select("id"), "id", "left_anti")
        missing = wanted - taken.count()
        new = spaced(rest, radius, kept).select(*candidates.columns)
        taken = taken.union(new.orderBy("rank", "id").limit(missing)).checkpoint()
        if not left or taken.count() >= wanted:
            return taken, radius
        radius /= shrink
