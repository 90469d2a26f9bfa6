"""Outlines of territories: sides with the owner on the left, linked into rings and put in order.

sides: side (a number of its own), owner, a and b (names of its ends), ax, ay, bx, by.  Going from a to b,
the owner's land is on the left, so outer rings run counter-clockwise and holes clockwise.  Where
rings of one owner touch in a point, each turns left as sharply as it can, so that rings are simple and land
that meets in a point alone has rings of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.plans import lists
from cartoweave.plans.components import ensure_checkpoint_dir


def square_sides(cells: DataFrame, owner: str, width: int) -> DataFrame:
    """Sides of territories of unit squares: cells has cell_id, x, y and the owner, 0 for nobody; width is that of the lattice."""
    c = cells.where(F.col(owner) != 0).select("cell_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(owner).alias("owner"))
    # counter-clockwise from the lower left: the neighbour beyond each side, and the side's ends
    around = ((0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0))
    one = [F.struct(F.lit(k).alias("k"), *((F.col(v) + d).alias(n) for v, d, n in zip("xyxyxy", at, ("nx", "ny", "ax", "ay", "bx", "by"), strict=True))) for k, at in enumerate(around)]
    each = c.select("cell_id", "owner", F.explode(F.array(*one)).alias("s")).select("cell_id", "owner", "s.*")
    same = c.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "owner")
    point = lambda x, y: F.col(y) * (width + 1) + F.col(x)
    return each.join(same, ["nx", "ny", "owner"], "left_anti").select((F.col("cell_id") * 4 + F.col("k")).alias("side"), "owner", point("ax", "ay").alias("a"), point("bx", "by").alias("b"), *(F.col(v).cast("double").alias(v) for v in ("ax", "ay", "bx", "by")))


def _turn(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Angle from one direction to another, left positive; straight back comes last."""
    cross, dot = x * y2 - y * x2, x * x2 + y * y2
    return F.when((cross == 0) & (dot < 0), -4.0).otherwise(F.atan2(cross, dot))


def trace(sides: DataFrame) -> DataFrame:
    """owner, ring (its least side), place, side, x, y, is_hole: the corners of all rings in order; x, y is where the side begins."""
    ensure_checkpoint_dir(sides.sparkSession)
    sides = sides.checkpoint()
    out = sides.select("owner", F.col("a").alias("b"), F.col("side").alias("next"), (F.col("bx") - F.col("ax")).alias("_x"), (F.col("by") - F.col("ay")).alias("_y"))
    turn = _turn(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("_x"), F.col("_y"))
    links = sides.join(out, ["owner", "b"]).groupBy(F.col("side").alias("node")).agg(F.max_by("next", F.struct(turn, -F.col("next"))).alias("next"))
    ranked = lists.rings(links)
    rows = sides.join(ranked, sides.side == ranked.node).select("owner", F.col("head").alias("ring"), "place", "side", "ax", "ay", (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("_area"))
    rows = rows.checkpoint()
    holes = rows.groupBy("ring").agg((F.sum("_area") < 0).alias("is_hole"))
    return rows.join(holes, "ring").select("owner", "ring", "place", "side", F.col("ax").alias("x"), F.col("ay").alias("y"), "is_hole")


def outlines(corners: DataFrame) -> DataFrame:
    """owner, ring, is_hole, n_corners, area, line: from trace(); line is the closed ring's corners in order, an array in one row, as a geometry is."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = corners.groupBy("owner", "ring", "is_hole").agg(points.alias("p")).withColumn("line", F.concat("p", F.slice("p", 1, 1)))
    pairs = F.zip_with(F.slice("line", F.lit(1), F.size("p")), F.slice("line", F.lit(2), F.size("p")), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return closed.select("owner", "ring", "is_hole", F.size("p").alias("n_corners"), (F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2).alias("area"), "line")


def wkt(line: Column) -> Column:
    """POLYGON text of a closed ring of whole or broken numbers."""
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", F.format_string("%.2f", p["x"]), F.format_string("%.2f", p["y"]))), ", "), F.lit("))"))
