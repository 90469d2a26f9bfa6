"""Voronoi cells of grid points: neighbours, corners, areas, Lloyd's relaxation.

Points are dealt to square blocks of BLOCK spacings; each block also gets the points within `reach`
spacings around it, so one shuffle of some 1.4 rows a point brings together all that a cell may need.
Inside a block, the edge between a cell and each near point is the part of their bisector that every
other near point leaves: a greatest and a least bound, in arrays.  A cell is certain if no point
beyond the reach could cut it, that is if its farthest corner is at most half the reach away; those
that aren't are built again with twice the reach, until it spans all points.

points: cell_id, x, y and is_edge, which marks the points around the map that bound the outer cells
and have no cell of their own.  Points have a bounded density, as grids do: BLOCK * BLOCK squares of
the spacing are one task's.  Rows with a null are no points; of points in one place the least cell_id
has the cell and the others an empty one; two cells that share a corner alone are no neighbours.  A cell
that no points close (at the rim of points without edge points) has closed = false, no corners and
no area; it makes its block see all points, so give edge points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.plans.components import ensure_checkpoint_dir

#: Spacings a block is wide, the first reach, and the shortest edge that counts.
BLOCK, REACH, SHORTEST = 32, 3, 1e-9
#: Cells built at a time, and numbers of an array of (cell, point, other point): with many near points fewer cells and points at a time.
CHUNK, ROOM = 128, 1 << 21

SCHEMA = "cell_id long, x double, y double, is_border boolean, closed boolean, neighbours array<long>, corners array<struct<x: double, y: double, b: long, c: long>>, area double, cx double, cy double"


def _edges(bx: np.ndarray, by: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For near points (cell, point), seen from the cell's own: whether there is an edge, and its ends along the bisector."""
    rows, m = bx.shape
    hi, lo, hidden = np.full((rows, m), np.inf), np.full((rows, m), -np.inf), np.zeros((rows, m), bool)
    step = max(1, ROOM // max(1, rows * m))
    for k in range(0, m, step):  # other points, a few at a time
        ox, oy = bx[:, None, k : k + step], by[:, None, k : k + step]
        turn = bx[:, :, None] * oy - by[:, :, None] * ox
        room = (ox * ox + oy * oy - bx[:, :, None] * ox - by[:, :, None] * oy) / 2
        others = real[:, None, k : k + step] & (np.arange(m)[:, None] != np.arange(k, min(m, k + step)))[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = room / turn
        hi = np.minimum(hi, np.where(others & (turn > 0), bound, np.inf).min(2))
        lo = np.maximum(lo, np.where(others & (turn < 0), bound, -np.inf).max(2))
        # a point in line with the two, between them
        hidden |= (others & (turn == 0) & (room < 0)).any(2)
    return real & ~hidden & (hi - lo > SHORTEST), lo, hi


def _built(t: pa.Table, width: float) -> pa.Table:
    """The cells of the own points of a block."""
    cid, x, y, grid, own = (t.column(c).to_numpy() for c in ("cell_id", "x", "y", "_grid", "_own"))
    order = np.lexsort((cid, y, x))
    cid, x, y, grid, own = (v[order] for v in (cid, x, y, grid, own))
    twin = np.append(False, (x[1:] == x[:-1]) & (y[1:] == y[:-1]))
    site = np.flatnonzero(~twin)
    parts = []
    mine = np.flatnonzero(own & ~twin)
    few = max(1, min(CHUNK, ROOM // max(1, len(site))))
    for i in range(0, len(mine), few):
        a = mine[i : i + few]
        dx, dy = x[site] - x[a, None], y[site] - y[a, None]
        far = dx * dx + dy * dy
        far[(far == 0) | (far > width * width)] = np.inf
        m = max(1, int(np.isfinite(far).sum(1).max()))
        near = far.argsort(1, kind="stable")[:, :m]
        real = np.isfinite(np.take_along_axis(far, near, 1))
        bx, by, near = np.take_along_axis(dx, near, 1), np.take_along_axis(dy, near, 1), site[near]
        has, lo, hi = _edges(bx, by, real)
        ended = np.isfinite(lo) & np.isfinite(hi)
        lo, hi = np.where(ended, lo, 0), np.where(ended, hi, 0)
        px, py, qx, qy = bx / 2 - lo * by, by / 2 + lo * bx, bx / 2 - hi * by, by / 2 + hi * bx
        reach = np.where(has, np.maximum(px * px + py * py, qx * qx + qy * qy), 0).max(1)
        closed = has.any(1) & (ended | ~has).all(1) & (4 * reach <= width * width)
        cross = np.where(has, px * qy - py * qx, 0)
        area = cross.sum(1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            cx, cy = (np.where(has, (p + q) * cross, 0).sum(1) / (6 * area) for p, q in ((px, qx), (py, qy)))
        row, col = np.nonzero(has)
        o = np.lexsort((np.arctan2(by, bx)[row, col], row))
        row, col = row[o], col[o]
        at = np.concatenate([[0], np.cumsum(has.sum(1))])
        # an edge's first corner lies between the point across it and the one before, around the cell
        before = np.arange(len(row)) - 1
        some = has.any(1)
        before[at[:-1][some]] = at[1:][some] - 1
        across = cid[near[row, col]]
        inner = grid[near[row, col]]
        keep = closed[row]
        ends = np.concatenate([[0], np.cumsum(np.where(closed, has.sum(1), 0))]).astype(np.int32)
        corner = pa.StructArray.from_arrays([pa.array((v[row, col] + w[a][row])[keep]) for v, w in ((px, x), (py, y))] + [pa.array(across[before][keep]), pa.array(across[keep])], ["x", "y", "b", "c"])
        # neighbours by id
        o = np.lexsort((across, row))
        row, across, inner = row[o], across[o], inner[o]
        n = np.concatenate([[0], np.cumsum(np.bincount(row[inner], minlength=len(a)))]).astype(np.int32)
        border = np.bincount(row[~inner], minlength=len(a)) > 0
        none = ~closed
        parts.append([pa.array(cid[a]), pa.array(x[a]), pa.array(y[a]), pa.array(border), pa.array(closed), pa.ListArray.from_arrays(n, pa.array(across[inner])), pa.ListArray.from_arrays(ends, corner), *(pa.array(v, mask=none) for v in (area, cx + x[a], cy + y[a]))])
    a = np.flatnonzero(own & twin)
    if len(a) or not parts:
        no = np.zeros(len(a) + 1, np.int32)
        none = pa.array([], pa.int64())
        empty = pa.StructArray.from_arrays([pa.array([], pa.float64())] * 2 + [none] * 2, ["x", "y", "b", "c"])
        off = np.zeros(len(a), bool)
        parts.append([pa.array(cid[a]), pa.array(x[a]), pa.array(y[a]), pa.array(off), pa.array(~off), pa.ListArray.from_arrays(no, none), pa.ListArray.from_arrays(no, empty), pa.array(np.zeros(len(a))), pa.array(x[a]), pa.array(y[a])])
    names = ["cell_id", "x", "y", "is_border", "closed", "neighbours", "corners", "area", "cx", "cy"]
    return pa.concat_tables([pa.table(p, names) for p in parts])


def _pass(sites: DataFrame, own, spacing: float, reach: int) -> DataFrame:
    """Cells of the points for which `own` holds; blocks without one get no rows."""
    at = {v: F.floor(F.col(v) / spacing) for v in "xy"}
    home = [F.floor(at[v] / BLOCK) for v in "xy"]
    around = [F.sequence(F.floor((at[v] - reach) / BLOCK), F.floor((at[v] + reach) / BLOCK)) for v in "xy"]
    dealt = sites.select("*", home[0].alias("_hx"), home[1].alias("_hy"), own.alias("_mine")).withColumn("_bx", F.explode(around[0])).withColumn("_by", F.explode(around[1]))
    dealt = dealt.withColumn("_own", F.col("_mine") & (F.col("_hx") == F.col("_bx")) & (F.col("_hy") == F.col("_by")))
    width = spacing * reach

    def build(t: pa.Table) -> pa.Table:
        return _built(t, width)

    return dealt.groupBy("_bx", "_by").applyInArrow(build, SCHEMA)


def cells(points: DataFrame, spacing: float) -> DataFrame:
    """A row for each point that isn't an edge point: its cell, corners counter-clockwise.

    A corner is where the cell meets those of b and c; is_border: the cell touches an edge point's.
    """
    ensure_checkpoint_dir(points.sparkSession)
    grid = F.coalesce(~F.col("is_edge"), F.lit(True))
    sites = points.select(F.col("cell_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), grid.alias("_grid")).dropna().checkpoint()
    built = _pass(sites, F.col("_grid"), spacing, REACH).checkpoint()
    done, reach = built, REACH
    widest = sites.agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0]
    while widest is not None and reach * spacing < 2 * widest:
        left = built.where("NOT closed")
        if left.isEmpty():
            break
        reach *= 2
        # only points near an open cell take part, by blocks
        block = lambda v: F.floor(F.floor(F.col(v) / spacing) / BLOCK)
        span = -(-reach // BLOCK)
        step = F.sequence(F.lit(-span), F.lit(span))
        near = left.select(block("x").alias("_x"), block("y").alias("_y")).distinct().withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).select((F.col("_x") + F.col("_i")).alias("_x"), (F.col("_y") + F.col("_j")).alias("_y")).distinct()
        some = sites.withColumn("_x", block("x")).withColumn("_y", block("y")).join(near, ["_x", "_y"], "left_semi").drop("_x", "_y")
        some = some.join(left.select("cell_id", F.lit(True).alias("_todo")), "cell_id", "left")
        built = _pass(some, F.coalesce("_todo", F.lit(False)) & F.col("_grid"), spacing, reach).where(F.col("cell_id").isNotNull()).checkpoint()
        done = done.where("closed").unionByName(built)
    return done


def edges(cells: DataFrame) -> DataFrame:
    """(src, dst), both directions."""
    return cells.select(F.col("cell_id").alias("src"), F.explode("neighbours").alias("dst"))


def vertices(cells: DataFrame) -> DataFrame:
    """a < b < c (the three points that a corner is equally far from), x, y, and the cells that have it."""
    k = F.explode("corners")
    each = cells.select("cell_id", k.alias("k")).select("cell_id", F.array_sort(F.array("cell_id", "k.b", "k.c")).alias("v"), "k.x", "k.y")
    return each.groupBy("v").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sort_array(F.collect_set("cell_id")).alias("cells")).select(*(F.col("v")[i].alias(n) for i, n in enumerate("abc")), "x", "y", "cells")


def vertex_edges(cells: DataFrame) -> DataFrame:
    """(src, dst) of corners that an edge of a cell joins, each named by its three points; both directions."""
    name = lambda k: F.array_sort(F.array("cell_id", k["b"], k["c"]))
    ring = cells.where(F.size("corners") > 0).select("cell_id", "corners", F.expr("concat(slice(corners, 2, size(corners) - 1), slice(corners, 1, 1))").alias("next"))
    pairs = ring.select("cell_id", F.explode(F.arrays_zip("corners", "next")).alias("p")).select(name(F.col("p.corners")).alias("src"), name(F.col("p.next")).alias("dst"))
    return pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def relaxed(points: DataFrame, spacing: float, width: float, height: float, rounds: int = 3) -> DataFrame:
    """points, each moved to the centroid of its cell, inside the map, `rounds` times; edge points and open cells stay."""
    points = points.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "is_edge")
    for _ in range(rounds):
        inside = lambda c, v, n: F.least(F.lit(float(n)), F.greatest(F.lit(0.0), F.coalesce(c, v)))
        moved = cells(points, spacing).select("cell_id", inside("cx", "x", width).alias("x"), inside("cy", "y", height).alias("y"), F.lit(False).alias("is_edge"))
        points = points.where("is_edge").unionByName(moved)
    return points
