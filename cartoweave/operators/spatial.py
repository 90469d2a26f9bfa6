"""Searches in the plane: boxes, radii, nearest neighbours, territories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoweave.functions import geometry as G
from cartoweave.plans.components import ensure_checkpoint_dir


def in_region(points: DataFrame, box: tuple, *also: Column) -> DataFrame:
    """Points (x, y) in a box, and other predicates; comparisons that reach the scan."""
    out = points.where(G.in_box(F.col("x"), F.col("y"), box))
    for p in also:
        out = out.where(p)
    return out


def radius_join(left: DataFrame, right: DataFrame, radius: float, how: str = "inner") -> DataFrame:
    """Pairs of left and right (both with x, y) at most radius apart, with `distance`.

    Right rows are copied to the 3 x 3 squares around theirs, and left rows meet them by an
    equi-join on the square, instead of comparing all with all.  Names of right get the suffix _r.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    r = right.select(*[F.col(f"`{c}`").alias(f"{c}_r") for c in right.columns])
    square = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    r = r.withColumn("_i", F.explode(F.transform(steps, lambda k: square("x_r") + k))).withColumn("_j", F.explode(F.transform(steps, lambda k: square("y_r") + k)))
    le = left.withColumn("_i", square("x")).withColumn("_j", square("y"))
    d = G.distance(F.col("x"), F.col("y"), F.col("x_r"), F.col("y_r"))
    if how == "inner":
        return le.join(r, ["_i", "_j"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_i", "_j")
    keep = (le["_i"] == r["_i"]) & (le["_j"] == r["_j"]) & (d <= radius)
    return le.join(r, keep, how).withColumn("distance", d).drop(le["_i"]).drop(le["_j"]).drop(r["_i"]).drop(r["_j"]) if how == "left" else le.join(r, keep, how).drop("_i", "_j")


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, radius: float) -> DataFrame:
    """The k nearest of right within radius for each row of left, ties by right_key; `place` counts from 1."""
    w = Window.partitionBy(key).orderBy("distance", f"{right_key}_r")
    return radius_join(left, right, radius).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def closest(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, radius: float, among: Column | None = None) -> DataFrame:
    """The k nearest of right for each row of left, at any distance; fewer only if right has fewer.

    Rows with fewer than k within the radius search again with twice the radius, until it spans
    all points.  key is unique in left; among, a condition on a pair, says which pairs count.
    """
    ensure_checkpoint_dir(left.sparkSession)
    ends = [f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))) for c in ("x", "y") for f in (F.min, F.max)]
    x0, x1, y0, y1 = left.select("x", "y").union(right.select("x", "y")).agg(*ends).first()
    span = 0.0 if None in (x0, x1, y0, y1) else ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    w = Window.partitionBy(key).orderBy("distance", f"{right_key}_r")
    open_, out = left, []
    while True:
        pairs = radius_join(open_, right, radius)
        near = (pairs if among is None else pairs.where(among)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).checkpoint()
        full = near.where(F.col("place") == k).select(key)
        last = radius > span
        out.append(near if last else near.join(full, key, "left_semi").select(*near.columns))
        open_ = open_.join(full, key, "left_anti").checkpoint()
        if last or open_.isEmpty():
            return reduce(DataFrame.unionByName, out)
        radius *= 2


def cell_at(x: Column, y: Column, spacing: float, wide: int, high: int) -> Column:
    """Number of the lattice cell at a point, points outside clamped to the border."""
    i = F.least(F.greatest(F.floor(x / spacing), F.lit(0)), F.lit(wide - 1))
    j = F.least(F.greatest(F.floor(y / spacing), F.lit(0)), F.lit(high - 1))
    return (i + j * wide).cast("long")


def territories(points: DataFrame, owners: DataFrame, names: dict[str, DataFrame]) -> DataFrame:
    """The record of each layer at each point: owners by cell, then a left join for each layer (id, name).

    names: layer -> DataFrame of <layer>_id and <layer>_name; 0 is nobody.
    """
    out = points.join(owners, "cell_id", "left")
    for layer, d in names.items():
        out = out.withColumn(f"{layer}_id", F.nullif(F.col(f"{layer}_id"), F.lit(0))).join(d, f"{layer}_id", "left")
    return out


def polygon_join(points: DataFrame, rings: DataFrame, square: float) -> DataFrame:
    """Points (x, y) in rings (ring_id, ring): squares that a ring's box touches, an equi-join, then the exact test."""
    lo = lambda c: F.floor(F.array_min(F.transform("ring", lambda p: p[c])) / square)
    hi = lambda c: F.floor(F.array_max(F.transform("ring", lambda p: p[c])) / square)
    r = rings.withColumn("_i", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("_j", F.explode(F.sequence(lo("y"), hi("y"))))
    p = points.withColumn("_i", F.floor(F.col("x") / square)).withColumn("_j", F.floor(F.col("y") / square))
    return p.join(r, ["_i", "_j"]).where(G.ring_contains(F.col("ring"), F.col("x"), F.col("y"))).drop("_i", "_j")


def boundary(owners: DataFrame, edges: DataFrame, owner: str) -> DataFrame:
    """(src, dst, owner, other): edges between cells of different owners, nobody's not counted as one."""
    o = owners.select("cell_id", F.col(owner).alias("owner"))
    other = o.select(F.col("cell_id").alias("dst"), F.col("owner").alias("other"))
    return edges.join(o, edges.src == o.cell_id).drop("cell_id").join(other, "dst").where("owner <> 0 AND owner <> other").select("src", "dst", "owner", "other")


def lines_in_box(rows: DataFrame, key: str, box: tuple) -> DataFrame:
    """The keys of lines (key, seq, x, y) that touch a box, also between their points; a line of one point by that point."""
    w = Window.partitionBy(key).orderBy("seq")
    x, y = F.col("x"), F.col("y")
    nxt = rows.select(key, "x", "y", F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y"))
    meets = F.coalesce(G.segment_meets_box(x, y, F.col("_x"), F.col("_y"), box), F.lit(False))
    return nxt.where(G.in_box(x, y, box) | meets).select(key).distinct()
