"""Voronoi cells: a place belongs to the cell of its nearest point; gaps, twins, nulls, rims, no points at all."""

from __future__ import annotations

import numpy as np
import pytest

from cartoweave.operators import voronoi
from cartoweave.sources import generator

SCHEMA = "cell_id long, x double, y double, is_edge boolean"


def inside(ring, x, y) -> bool:
    """Whether a place is in a convex counter-clockwise ring, its rim included."""
    return all((b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x) >= -1e-6 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def holds(found, sites, probes):
    at = {r.cell_id: r for r in found}
    xy = np.array([(s[1], s[2]) for s in sites])
    for x, y in probes:
        d = ((xy - (x, y)) ** 2).sum(1)
        near = sites[int(d.argmin())]
        if not near[3]:
            assert inside(at[near[0]].corners, x, y)
            other = [r for r in found if r.cell_id != near[0]][int(x) % (len(found) - 1)]
            assert np.sort(d)[1] - d.min() < 1e-6 or not inside(other.corners, x, y)


def test_gap(spark):
    """A hole of 20 spacings: cells at its rim need points from far beyond the first reach."""
    points = generator.grid_points(spark, 600, 450, 10, 3).collect()
    sites = [tuple(r) for r in points if not (200 < r.x < 400 and 150 < r.y < 300)]
    found = voronoi.cells(spark.createDataFrame(sites, SCHEMA).repartition(7), 10).collect()
    assert len(found) == sum(not s[3] for s in sites)
    assert all(r.closed and r.area > 0 and len(r.corners) >= 3 for r in found)
    rng = np.random.default_rng(5)
    holds(found, sites, rng.uniform((0, 0), (600, 450), (300, 2)))
    holds(found, sites, rng.uniform((200, 150), (400, 300), (200, 2)))
    ids = {r.cell_id: r for r in found}
    assert all(r.cell_id in ids[n].neighbours for r in found for n in r.neighbours)
    edge = {s[0] for s in sites if s[3]}
    assert all(r.is_border == any(c.b in edge for c in r.corners) for r in found)


def test_lattice_twins_nulls(spark):
    """On an exact lattice four cells meet in a corner, and those across it are no neighbours."""
    sites = [(i, float(i % 7), float(i // 7), i % 7 in (0, 6) or i // 7 in (0, 6)) for i in range(49)]
    more = [(100, 3.0, 3.0, False), (101, None, 2.0, False), (None, 1.5, 1.5, False), (102, 2.5, None, None)]
    df = spark.createDataFrame(sites + more, SCHEMA)
    found = {r.cell_id: r for r in voronoi.cells(df, 1.0).collect()}
    assert set(found) == {s[0] for s in sites if not s[3]} | {100}
    assert found[24].neighbours == [17, 23, 25, 31] and found[24].area == pytest.approx(1) and not found[24].is_border
    assert (found[24].cx, found[24].cy) == pytest.approx((3, 3))
    assert found[8].neighbours == [9, 15] and found[8].is_border
    twin = found[100]
    assert twin.closed and twin.area == 0 and not twin.neighbours and not twin.corners


def test_rim_and_none(spark):
    """Without points around them the outer cells stay open; no points give no rows."""
    sites = [(i, float(i % 4), float(i // 4), False) for i in range(16)]
    found = {r.cell_id: r for r in voronoi.cells(spark.createDataFrame(sites, SCHEMA), 1.0).collect()}
    assert {i for i, r in found.items() if r.closed} == {5, 6, 9, 10}
    assert found[0].area is None and not found[0].corners and found[0].neighbours == [1, 4]
    none = voronoi.cells(spark.createDataFrame([], SCHEMA), 1.0)
    assert none.collect() == [] and voronoi.edges(none).collect() == [] and voronoi.vertices(none).collect() == []
    one = voronoi.cells(spark.createDataFrame([(7, 0.5, 0.5, None)], SCHEMA), 1.0).collect()
    assert [(r.cell_id, r.closed, r.neighbours) for r in one] == [(7, False, [])]


def test_relaxed(spark):
    """Relaxation brings places nearer to their nearest point, and keeps the points around the map."""
    points = generator.grid_points(spark, 300, 200, 10, 3)
    after = voronoi.relaxed(points, 10, 300, 200)
    outer = lambda d: sorted((r.cell_id, r.x, r.y) for r in d.where("is_edge").collect())
    assert outer(after) == outer(points)
    places = np.random.default_rng(1).uniform((10, 10), (290, 190), (2000, 2))

    def energy(d):
        xy = np.array([(r.x, r.y) for r in d.collect()])
        return ((places[:, None] - xy) ** 2).sum(2).min(1).mean()

    assert energy(after) < energy(points)


def test_plan(spark):
    """One shuffle brings a block together, from the points alone."""
    points = generator.grid_points(spark, 300, 200, 10, 3)
    from pyspark.sql import functions as F

    plan = voronoi._pass(points.withColumn("_grid", ~F.col("is_edge")), F.col("_grid"), 10, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_far_apart_and_dense(spark):
    """A point ringed by eight edge points 60 spacings away has a cell; dense points are built in bounded arrays."""
    import math

    ring = [(i + 1, 100 + 60 * math.cos(i * math.pi / 4), 100 + 60 * math.sin(i * math.pi / 4), True) for i in range(8)]
    got = voronoi.cells(spark.createDataFrame([(0, 100.0, 100.0, False), *ring], "cell_id long, x double, y double, is_edge boolean"), 1.0).collect()
    assert [(r.cell_id, r.closed, len(r.corners)) for r in got] == [(0, True, 8)]
    assert abs(got[0].area - 8 * 30 * 30 * math.tan(math.pi / 8)) < 1e-6


def test_many_near_points_in_slabs(monkeypatch):
    import random

    rng = random.Random(1)
    points = [(i, rng.uniform(0, 12), rng.uniform(0, 12), False) for i in range(300)]
    points += [(1000 + i, float(x), float(y), True) for i, (x, y) in enumerate([(a, b) for a in range(-4, 17) for b in (-4, 16)] + [(b, a) for a in range(-3, 16) for b in (-4, 16)])]
    width = 6.0
    import pyarrow as pa

    table = pa.table({"cell_id": [p[0] for p in points], "x": [p[1] for p in points], "y": [p[2] for p in points], "_grid": [not p[3] for p in points], "_own": [not p[3] for p in points]})
    whole = voronoi._built(table, width)
    monkeypatch.setattr(voronoi, "ROOM", 5_000)
    few = voronoi._built(table, width)
    assert few.column("neighbours").to_pylist() == whole.column("neighbours").to_pylist() and sum(whole.column("closed").to_pylist()) > 200
    assert [round(a or 0, 9) for a in few.column("area").to_pylist()] == [round(a or 0, 9) for a in whole.column("area").to_pylist()]
