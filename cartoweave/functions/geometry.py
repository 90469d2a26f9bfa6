"""Planar geometry in plain columns: points as x, y; lines and rings as arrays of struct<x,y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _xy(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    return a["x"], a["y"], b["x"], b["y"]


def _closed_next(ring: Column) -> Column:
    """The ring moved by one point, so that zipped pairs are its sides."""
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray cast: whether a ray to the right crosses the ring's sides an odd number of times."""

    def crosses(a, b):
        x1, y1, x2, y2 = _xy(a, b)
        return F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, _closed_next(ring), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def ring_area2(ring: Column) -> Column:
    """Twice the signed area (shoelace)."""
    cross = F.zip_with(ring, _closed_next(ring), lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)


def ring_centroid(ring: Column) -> Column:
    """struct<x,y>; the mean of the points where the area is 0."""
    nxt = _closed_next(ring)
    part = lambda k: F.aggregate(F.zip_with(ring, nxt, lambda a, b: ((a[k] + b[k]) * (a["x"] * b["y"] - b["x"] * a["y"])).cast("double")), F.lit(0.0), lambda s, c: s + c)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    area = ring_area2(ring)
    return F.struct(*[F.when(area == 0, mean(k)).otherwise(part(k) / F.nullif(3 * area, F.lit(0.0))).alias(k) for k in ("x", "y")])


def line_length(line: Column) -> Column:
    """Sum of the lengths of the segments; 0 for fewer than two points."""
    pairs = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: distance(*_xy(a, b)).cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))


def in_box(x: Column, y: Column, box: tuple) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def segment_meets_box(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple) -> Column:
    """Whether a segment touches a box: their extents meet, and the box's corners are not all on one side of the line."""
    bx0, by0, bx1, by1 = box
    side = lambda x, y: (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    corners = [side(F.lit(x), F.lit(y)) for x in (bx0, bx1) for y in (by0, by1)]
    extents = (F.greatest(x1, x2) >= bx0) & (F.least(x1, x2) <= bx1) & (F.greatest(y1, y2) >= by0) & (F.least(y1, y2) <= by1)
    return extents & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
