"""Quadtrees of points, joins through them, spaced choice, and snapshots of worlds, against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cartoweave.operators import spacing, tiles
from cartoweave.sources import store

SCHEMA = "id long, x double, y double"


def crowded(rng, n):
    """Half of the points in one small square, some of them at one place."""
    return [(i, 3.0, -2.0) if i % 8 == 0 else (i, rng.uniform(3, 3.05), rng.uniform(-2, -1.95)) if i % 2 else (i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(n)]


def test_tree_splits_full_squares(spark):
    points = spark.createDataFrame(crowded(random.Random(1), 800), SCHEMA)
    nodes = tiles.tree(points, 4.0, 20, 9).cache()
    leaves = nodes.where("leaf")
    assert leaves.agg(F.sum("n")).first()[0] == 800
    assert leaves.where("n > 20 AND level < 9").count() == 0 and leaves.where("level > 4").count() > 10
    at = tiles.leaf_of(points, nodes, 4.0)
    assert at.groupBy("id").count().where("count <> 1").count() == 0 and at.count() == 800
    assert at.groupBy("level", "i", "j", "n").count().where("n <> count").count() == 0


def test_radius_join_of_a_dense_square(spark, monkeypatch):
    monkeypatch.setattr(tiles, "SALT", 1)
    rng = random.Random(2)
    a, b = crowded(rng, 160), crowded(rng, 400)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    for radius in (0.02, 2.5):
        want = sorted((p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) <= radius)
        assert sorted((r.id, r.id_r) for r in tiles.radius_join(left, right, radius, 16, 5).collect()) == want
    odd = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 2.0), (3, float("inf"), 0.0), (4, 3.0, -2.0)], SCHEMA)
    assert {r.id for r in tiles.radius_join(odd, right, 0.5, 16, 5).collect()} == {4}
    assert {r.id_r for r in tiles.radius_join(left, odd, 0.5, 16, 5).collect()} == {4}
    assert tiles.radius_join(left, right.limit(0), 1.0).count() == tiles.radius_join(left.limit(0), right, 1.0).count() == 0
    with pytest.raises(ValueError):
        tiles.radius_join(left, right, 0)


def test_no_join_key_has_a_dense_square(spark):
    """Half of all rows in one square of the radius: no leaf holds more than `most`, and each left row meets few leaves that it doesn't need."""
    right = spark.range(20000).select("id", (F.rand(1) * F.when(F.col("id") % 2 == 0, 1).otherwise(100)).alias("x"), (F.rand(2) * F.when(F.col("id") % 2 == 0, 1).otherwise(100)).alias("y")).cache()
    nodes = tiles.tree(right, 1.0, 100)
    assert nodes.where("level = 0").agg(F.max("n")).first()[0] > 10000
    assert nodes.where("leaf").agg(F.max("n")).first()[0] <= 100
    assert tiles.touched(right.where("id % 2 = 0").limit(50), nodes, 1.0, 0.01).groupBy("id").count().agg(F.max("count")).first()[0] <= 4


def test_nearest_site_at_any_distance(spark):
    rng = random.Random(4)
    a = [(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(60)] + [(60, 3.0, -2.0), (61, 900.0, 900.0)]
    b = [(i, round(x, 3), round(y, 3)) for i, x, y in crowded(rng, 200)]
    got = tiles.nearest_site(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, "site long, x double, y double"), "id", "site", 0.5, 20)
    assert {r.id: r.site for r in got.collect()} == {p[0]: min(b, key=lambda q: (math.dist(p[1:], q[1:]), q[0]))[0] for p in a}


def greedy(points, radius, among=()):
    taken = list(among)
    for p in sorted(points, key=lambda p: (p[3], p[0])):
        if all(math.dist(p[1:3], q[1:3]) >= radius for q in taken):
            taken.append(p)
    return {p[0] for p in taken[len(among) :]}


@pytest.mark.parametrize("order", ["random", "ties", "slope"])
def test_spaced_choice_by_squares(spark, order):
    rng = random.Random(5)
    points = [(i, x, y, {"random": rng.random(), "ties": float(rng.randrange(3)), "slope": x}[order]) for i, x, y in crowded(rng, 300)]
    candidates = spark.createDataFrame(points, SCHEMA + ", rank double")
    assert {r.id for r in spacing.spaced(candidates, 3.0).collect()} == greedy(points, 3.0)
    first = [p for p in points if p[0] in greedy(points, 9.0)]
    rest = [p for p in points if p[0] not in greedy(points, 9.0)]
    got = spacing.spaced(spark.createDataFrame(rest, SCHEMA + ", rank double"), 3.0, spark.createDataFrame([p[1:3] for p in first], "x double, y double"))
    assert {r.id for r in got.collect()} == greedy(rest, 3.0, first)


def test_spaced_choice_writes_no_pairs(spark):
    """A third of all candidates in one square: what a round makes follows the squares, and nulls are never taken."""
    n = 6000
    rows = spark.range(n).select("id", (F.rand(1) * F.when(F.col("id") % 3 == 0, 0.5).otherwise(60)).alias("x"), (F.rand(2) * F.when(F.col("id") % 3 == 0, 0.5).otherwise(60)).alias("y"), F.rand(3).alias("rank")).checkpoint()
    squares = spacing._squares(rows, 2.0)
    assert spacing._spread(squares.groupBy("_i", "_j").count()).count() <= 25 * math.ceil(60 / 1.4 + 1) ** 2
    local = [tuple(r) for r in rows.collect()]
    odd = spark.createDataFrame([(n, None, 1.0, -1.0), (n + 1, 70.0, 70.0, None)], SCHEMA + ", rank double")
    assert {r.id for r in spacing.spaced(rows.union(odd), 2.0).collect()} == greedy(local, 2.0)


def test_fewer_than_wanted_stay_and_the_radius_shrinks(spark):
    points = [(i, i % 7 * 1.0, i // 7 * 1.0, i) for i in range(49)]
    d = spark.createDataFrame(points, "id long, x double, y double, rank long")
    taken, radius = spacing.spaced_enough(d, 3.0, 12, tries=9)
    ids, r = [], 3.0
    while True:
        have = [p for p in points if p[0] in ids]
        new = greedy([p for p in points if p[0] not in ids], r, have)
        ids += sorted(new)[: 12 - len(ids)]
        if len(ids) == 12:
            break
        r /= 1.2
    assert {x.id for x in taken.collect()} == set(ids) and radius == pytest.approx(r) and r < 3.0


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "w")
    cells = lambda k: spark.createDataFrame([(1, i, i, i, k) for i in range(5)], "map_id long, cell_id long, x long, y long, height long")
    towns = spark.createDataFrame([(1, 7, 4), (1, 8, 0)], "map_id long, id long, cell_id long")
    assert store.snapshots(spark, path) == store.versions(spark, path) == []
    with pytest.raises(ValueError):
        store.pin(spark, path)
    store.save_world({"cells": cells(1), "settlements": towns}, path, "a")
    pinned = store.pin(spark, path)
    before = store.scan(spark, path, "cells", 1)  # planned before, run after
    store.save_world({"cells": cells(2)}, path, "a")
    assert before.agg(F.max("height")).first()[0] == store.read(spark, path, "cells", pinned).agg(F.max("height")).first()[0] == 1
    assert store.scan(spark, path, "cells", 1).agg(F.max("height")).first()[0] == 2
    assert store.read(spark, path, "settlements", pinned).count() == 2
    with pytest.raises(ValueError, match="no settlements"):  # the second save has none, and none is left of the first
        store.read(spark, path, "settlements")
    with pytest.raises(ValueError, match="settlements.cell_id': 1"):
        store.save_world({"cells": cells(3), "settlements": towns.union(spark.createDataFrame([(1, 9, 77)], towns.schema))}, path, "b")
    assert store.versions(spark, path) == ["a"]
    # a manifest that another writer put there first isn't replaced
    real = store.snapshots
    try:
        store.snapshots = lambda *a: real(*a)[:-1]
        store.save_world({"cells": cells(4)}, path, "c")
    finally:
        store.snapshots = real
    assert [(m["number"], m["version"]) for m in store.snapshots(spark, path)] == [(1, "a"), (2, "a"), (3, "c")]
    assert store.expire(spark, path, 1) == 3 and store.versions(spark, path) == ["c"]
    assert store.scan(spark, path, "cells", 1).count() == 5
