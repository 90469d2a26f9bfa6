"""Outlines, watersheds and ordered edits, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartoweave.operators import edits, graph, spatial, territory, watershed
from cartoweave.plans import blocks, lists


def lattice(n, width):
    return [(i, j) for i in range(n) for j in ([i - 1] if i % width else []) + ([i + 1] if i % width < width - 1 and i + 1 < n else []) + ([i - width] if i >= width else []) + ([i + width] if i + width < n else [])]


def test_list_ranking(spark):
    rng = random.Random(1)
    want, links = {}, []
    ids = list(range(200))
    rng.shuffle(ids)
    for size in (1, 2, 3, 64, 130):
        ring = [ids.pop() for _ in range(size)]
        at = ring.index(min(ring))
        ring = ring[at:] + ring[:at]
        links += list(zip(ring, ring[1:] + ring[:1], strict=True))
        want |= {node: (ring[0], k) for k, node in enumerate(ring)}
    got = lists.rings(spark.createDataFrame(links, "node long, next long"))
    assert {r.node: (r.head, r.place) for r in got.collect()} == want


def test_rings_enclose_their_cells(spark):
    """Areas add up to cells, holes run clockwise, corner neighbours have rings of their own, and points lie inside by even and odd."""
    rng = random.Random(3)
    w, n = 9, 81
    owner = [rng.choice([0, 1, 1, 2]) for _ in range(n)]
    for i in (20, 21, 22, 29, 31, 38, 39, 40):
        owner[i] = 3  # a ring of cells
    owner[30] = 0
    cells = spark.createDataFrame([(i, i % w, i // w, o) for i, o in enumerate(owner)], "cell_id long, x long, y long, owner long")
    corners = territory.trace(territory.square_sides(cells, "owner", w)).checkpoint()
    out = territory.outlines(corners).collect()
    for o in (1, 2, 3):
        assert sum(r.area for r in out if r.owner == o) == owner.count(o)
    assert sorted((r.is_hole, r.area, r.n_corners) for r in out if r.owner == 3) == [(False, 9.0, 12), (True, -1.0, 4)]
    assert all(r.is_hole == (r.area < 0) and r.line[0] == r.line[-1] and len(r.line) == r.n_corners + 1 for r in out)
    rings = territory.outlines(corners).select("owner", F.col("ring").alias("ring_id"), F.slice("line", F.lit(1), F.col("n_corners")).alias("ring"))
    points = cells.select("cell_id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"))
    inside = spatial.polygon_join(points, rings, 4.0).groupBy("cell_id", "owner").count().where("count % 2 = 1").collect()
    assert {r.cell_id: r.owner for r in inside} == {i: o for i, o in enumerate(owner) if o}


def test_touching_corners(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1), (1, 1, 0, 0), (2, 0, 1, 0), (3, 1, 1, 1)], "cell_id long, x long, y long, owner long")
    out = territory.outlines(territory.trace(territory.square_sides(cells, "owner", 2))).collect()
    assert [(r.n_corners, r.area) for r in out] == [(4, 1.0)] * 2
    assert territory.trace(territory.square_sides(cells.where("owner = 9"), "owner", 2)).count() == 0
    text = territory.outlines(territory.trace(territory.square_sides(cells, "owner", 2))).select(territory.wkt(F.col("line")).alias("t")).collect()
    assert "POLYGON((0.00 0.00, 1.00 0.00, 1.00 1.00, 0.00 1.00, 0.00 0.00))" in {r.t for r in text}


def brute_watersheds(heights, border, near):
    n = len(heights)
    down = [None if border[i] or not near[i] else min(near[i], key=lambda j: (heights[j], j)) for i in range(n)]
    down = [d if d is not None and (heights[d], d) < (heights[i], i) else None for i, d in enumerate(down)]

    def pit(i):
        while down[i] is not None:
            i = down[i]
        return -1 if border[i] else i

    basin = [pit(i) for i in range(n)]
    ways = {}
    for i in range(n):
        for j in near[i]:
            if basin[i] != basin[j]:
                key = (max(heights[i], heights[j]), min(i, j), max(i, j))
                pair = (min(basin[i], basin[j]), max(basin[i], basin[j]))
                ways[pair] = min(ways.get(pair, key), key)
    up = {b: b for b in {*basin, -1}}

    def top(b):
        while up[b] != b:
            b = up[b]
        return b

    tree = {b: [] for b in up}
    for (a, b), (h, i, j) in sorted(ways.items(), key=lambda x: x[1]):
        if top(a) != top(b):
            up[max(top(a), top(b))] = min(top(a), top(b))
            u, v = (i, j) if basin[i] == a else (j, i)
            tree[a].append((b, h, u, v))
            tree[b].append((a, h, v, u))
    found, todo = {}, [(-1, None)]
    while todo:
        at, level = todo.pop()
        for b, h, u, v in tree[at]:
            if b not in found and b != -1:
                found[b] = (at, float(h), v, u, float(max(h, level if level is not None else h)))
                todo.append((b, found[b][4]))
    return basin, found


@pytest.mark.parametrize("seed, flat", [(1, False), (2, True)])
def test_watersheds(spark, seed, flat, monkeypatch):
    monkeypatch.setattr(blocks, "FEWEST", 60)
    rng = random.Random(seed)
    w, n = 12, 156
    heights = [rng.choice([10, 20, 30]) if flat else rng.randint(0, 90) for _ in range(n)]
    border = [i % w in (0, w - 1) or i < w or i + w >= n for i in range(n)]
    pairs = lattice(n, w)
    near = [[j for i2, j in pairs if i2 == i] for i in range(n)]
    basin, want = brute_watersheds(heights, border, near)
    cells = spark.createDataFrame([(i, h, b) for i, (h, b) in enumerate(zip(heights, border, strict=True))], "cell_id long, height long, is_border boolean")
    edge = spark.createDataFrame(pairs, "src long, dst long")
    found = watershed.basins(cells, edge).checkpoint()
    assert {r.cell_id: r.basin for r in found.collect()} == dict(enumerate(basin))
    levels, tree = watershed.contracted(watershed.passes(found, edge))
    t = watershed.lake_tree(levels, tree).checkpoint()
    assert {r.lake: (r.parent, r.pass_height, r.outlet, r.beyond, r.level) for r in t.collect()} == want
    assert {tuple(r) for r in watershed.filled(found, levels).collect()} == {tuple(r) for r in graph.flood(cells, edge).collect()}
    rain = spark.createDataFrame([(i, rng.randint(0, 9)) for i in range(n)], "cell_id long, precip long")
    flux = {r.lake: (r.own, r.total) for r in watershed.lake_flux(found, t, rain).collect()}
    assert flux[-1][1] == rain.agg(F.sum("precip")).first()[0]  # all water leaves the map
    for lake, (own, total) in flux.items():
        assert total == own + sum(flux[b][1] for b, x in want.items() if x[0] == lake)


def test_watersheds_without_a_way_out(spark):
    cells = spark.createDataFrame([(0, 5, False), (1, 9, False), (2, 3, False)], "cell_id long, height long, is_border boolean")
    edge = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long")
    found = watershed.basins(cells, edge).checkpoint()
    levels, tree = watershed.contracted(watershed.passes(found, edge))
    assert {(r.basin, r.level) for r in levels.collect()} == {(0, None), (2, None)}
    assert {(r.lake, r.parent) for r in watershed.lake_tree(levels, tree).collect()} == {(0, None), (2, None)}
    assert {tuple(r) for r in watershed.filled(found, levels).collect()} == {(0, 5), (1, 9), (2, 3)}


def test_edits_of_a_hot_cell(spark):
    """Half of all edits are of one cell, which many tasks share; the fold is that of one after the other."""
    rng = random.Random(7)
    log = [(k, rng.choice(["set_height", "adjust_height", "adjust_height", "adjust_height", "smooth"]), 5 if rng.random() < 0.5 else rng.randrange(40), rng.randint(-30, 30)) for k in range(20_000)]
    log = [e if e[2] != 7 or e[1] == "adjust_height" else (*e[:1], "adjust_height", *e[2:]) for e in log]  # one is never set
    want = {i: 20 for i in range(41)}
    for _, op, cell, delta in log:
        if op == "set_height":
            want[cell] = max(delta, 0)
        elif op == "adjust_height":
            want[cell] = max(want[cell] + delta, 0)
    rng.shuffle(log)
    rows = spark.createDataFrame([*log, (30_000, "set_height", None, 1), (30_001, "adjust_height", 3, None)], "edit_id long, op string, cell_id long, delta long").repartition(8)
    cells = spark.createDataFrame([(i, 20) for i in range(41)], "cell_id long, height int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = edits.fold_heights(cells, rows)
        assert {r.cell_id: r.height for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
