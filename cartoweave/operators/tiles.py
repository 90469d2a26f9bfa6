"""A quadtree of squares that follows the points: full squares are split, so a dense town is many join keys and not one.

Level 0 has squares of a given side; a square with more than MOST points is split into four, down to DEPTH levels.  What
is still full then (points at one place, nearly) is dealt to numbered pieces by a hash of the row.  Nodes are
counted from pre-aggregated finest squares, so the tree is made by sums and never by rows of one square.
Node tables are broadcast up to NODES rows and joined by a shuffle beyond.  Points without coordinates, or with NaN or infinite ones, are in no square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.functions import geometry as G
from cartoweave.plans.components import ensure_checkpoint_dir

#: Points of a leaf, levels below the first, nodes of a broadcast table, left rows of a join key over the points of a leaf.
MOST, DEPTH, NODES, SALT = 4096, 12, 1_000_000, 16


def _meet(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of nodes, which is broadcast only if its count says so."""
    return rows.join(F.broadcast(table) if table.count() <= NODES else table, on, how)


def _square(v: str, side: float, level: int | Column) -> Column:
    """Number of a square along an axis, at a level."""
    scale = F.lit(float(1 << level)) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(F.col(v).cast("double") / F.lit(float(side)) * scale)


def _placed(points: DataFrame) -> DataFrame:
    """Points that have a place."""
    fine = lambda v: F.col(v).isNotNull() & (F.abs(F.col(v).cast("double")) < float("inf"))
    return points.where(fine("x") & fine("y"))


def tree(points: DataFrame, side: float, most: int = MOST, depth: int = DEPTH) -> DataFrame:
    """level, i, j, n, leaf: the nodes over points (x, y); leaves cover every point once, and only those of the last level have more than `most`."""
    if side <= 0 or most < 1:
        raise ValueError("side and most must be positive")
    ensure_checkpoint_dir(points.sparkSession)
    fine = _placed(points).groupBy(_square("x", side, depth).alias("fi"), _square("y", side, depth).alias("fj")).agg(F.count("*").alias("n")).checkpoint()
    out = []
    for level in range(depth + 1):
        up = depth - level
        at = fine.withColumns({"i": F.shiftright("fi", up), "j": F.shiftright("fj", up)})
        nodes = at.groupBy("i", "j").agg(F.sum("n").alias("n")).withColumn("leaf", (F.col("n") <= most) | F.lit(level == depth)).checkpoint()
        out.append(nodes.select(F.lit(level).alias("level"), "i", "j", "n", "leaf"))
        full = nodes.where("NOT leaf").select("i", "j")
        if level == depth or full.isEmpty():
            break
        fine = _meet(at, full, ["i", "j"], "left_semi").select("fi", "fj", "n").checkpoint()
    return reduce(DataFrame.union, out)


def leaf_of(points: DataFrame, nodes: DataFrame, side: float) -> DataFrame:
    """points with level, i, j and n of the leaf that they lie in; points in no leaf go."""
    leaves = nodes.where("leaf").drop("leaf")
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    levels = F.array(*[F.struct(F.lit(k).alias("level"), _square("x", side, k).alias("i"), _square("y", side, k).alias("j")) for k in range(deepest + 1)])
    each = _placed(points).withColumn("_at", F.explode(levels)).select(*(F.col(f"`{c}`") for c in points.columns), "_at.*")
    return _meet(each, leaves, ["level", "i", "j"])


def touched(points: DataFrame, nodes: DataFrame, side: float, radius: float) -> DataFrame:
    """points with level, i, j and n of each leaf that the circle around them touches: a descent of one join a level, into nodes that are there."""
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return points.limit(0).withColumns({"level": F.lit(0), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    names = [F.col(f"`{c}`") for c in points.columns]
    first = lambda v, d: F.floor((F.col(v).cast("double") + d * radius) / side)
    at = _placed(points).withColumn("i", F.explode(F.sequence(first("x", -1), first("x", 1)))).withColumn("j", F.explode(F.sequence(first("y", -1), first("y", 1))))
    out = []
    for level in range(deepest + 1):
        size = side / (1 << level)
        gap = lambda v, k: F.greatest(F.col(k) * size - F.col(v), F.col(v) - (F.col(k) + 1) * size, F.lit(0.0))  # noqa: B023, E731
        # a touch wider, so that rounding loses no square
        near = gap("x", "i") * gap("x", "i") + gap("y", "j") * gap("y", "j") <= (radius * (1 + 1e-9)) ** 2 + 1e-18
        found = _meet(at.where(near), nodes.where(F.col("level") == level).drop("level"), ["i", "j"]).checkpoint()
        out.append(found.where("leaf").select(*names, F.lit(level).alias("level"), "i", "j", "n"))
        at = found.where("NOT leaf").select(*names, "i", "j")
        at = at.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(4)]))).select(*names, (F.col("i") * 2 + F.col("_k") % 2).alias("i"), (F.col("j") * 2 + F.shiftright("_k", 1)).alias("j"))
    return reduce(DataFrame.union, out)


def radius_join(left: DataFrame, right: DataFrame, radius: float, most: int = MOST, depth: int = DEPTH) -> DataFrame:
    """Pairs of left and right (both with x, y) at most radius apart, with `distance`; names of right get the suffix _r.

    Right rows are in one leaf each, left rows go to the leaves that their circles touch.  A leaf of the last level with
    more than `most` rows is as many pieces as it needs: its right rows are dealt by a hash of all their columns, left rows go to each piece.  Where more
    than SALT times `most` left rows meet in a leaf they are dealt by a hash likewise, and its right rows, few as they are, go to each salt.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    nodes = tree(right, radius, most, depth).checkpoint()
    leaf = ["level", "i", "j"]
    dealt = lambda rows, n: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), n).cast("int")
    pieces, salts = F.ceil(F.col("n") / most).cast("int"), F.ceil(F.col("_copies") / (most * SALT)).cast("int")
    le = touched(left, nodes, radius, radius)
    copies = le.groupBy(*leaf).agg(F.count("*").alias("_copies")).checkpoint()
    le = _meet(le, copies, leaf).withColumn("_salt", dealt(left, salts)).withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n", "_copies")
    r = _meet(leaf_of(right, nodes, radius), copies, leaf)
    r = r.select(*[F.col(f"`{c}`").alias(f"{c}_r") for c in right.columns], *leaf, dealt(right, pieces).alias("_piece"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    d = G.distance(F.col("x"), F.col("y"), F.col("x_r"), F.col("y_r"))
    return le.join(r, [*leaf, "_piece", "_salt"]).withColumn("distance", d).where(F.col("distance") <= radius).drop(*leaf, "_piece", "_salt")


def nearest_site(points: DataFrame, sites: DataFrame, key: str, site: str, reach: float, most: int = MOST) -> DataFrame:
    """points with the site that is nearest, ties to the lesser, and its distance: the cell of a Voronoi world in which a point lies.

    key is unique in points.  A site found within the reach is a certificate: all squares of the circle were
    searched.  Points without one search again, four times as far, until the circle spans all; each search has a tree of its own squares.
    """
    ensure_checkpoint_dir(points.sparkSession)
    s = sites.select(F.col(site).alias(site), "x", "y")
    ends = _placed(points).select("x", "y").union(_placed(s).select("x", "y")).agg(*[f(F.col(c).cast("double")) for c in ("x", "y") for f in (F.min, F.max)]).first()
    span = 0.0 if None in ends else ((ends[1] - ends[0]) ** 2 + (ends[3] - ends[2]) ** 2) ** 0.5
    open_, out = points, []
    while True:
        pairs = radius_join(open_.select(key, "x", "y"), s, reach, most)
        best = pairs.groupBy(key).agg(F.min(F.struct("distance", f"{site}_r")).alias("_best")).checkpoint()
        out.append(best)
        open_ = open_.join(best, key, "left_anti").checkpoint()
        if reach > span or open_.isEmpty():
            break
        reach *= 4
    found = reduce(DataFrame.union, out).select(key, F.col(f"_best.{site}_r").alias(site), F.col("_best.distance").alias("distance"))
    return points.join(found, key)
