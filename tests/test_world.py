"""Operators on small worlds: properties, brute force, and the distributed forms against the sequential ones."""

from __future__ import annotations

import itertools
import math
import random
import re

import pytest
import serial
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartoweave.functions import geometry as G
from cartoweave.operators import edits as D
from cartoweave.operators import graph as N
from cartoweave.operators import names, spacing, spatial
from cartoweave.plans.components import connected_components
from cartoweave.plans.fixpoint import gather_downstream
from cartoweave.sources import generator, store
from cartoweave.streaming import edit_log


def lattice(spark, heights, wide):
    n = len(heights)
    high = n // wide
    rows = [(0, i, i % wide, i // wide, h, i % wide in (0, wide - 1) or i // wide in (0, high - 1), 1 + i % 3) for i, h in enumerate(heights)]
    edges = [(0, i, j) for i in range(n) for j in ((i - 1) if i % wide else -1, (i + 1) if i % wide < wide - 1 else -1, i - wide, i + wide) if 0 <= j < n]
    cells = spark.createDataFrame(rows, "map_id long, cell_id long, x long, y long, height long, is_border boolean, precip long")
    return cells, spark.createDataFrame(edges, "map_id long, src long, dst long")


def values(df, key="cell_id"):
    return {r[key]: tuple(r[c] for c in df.columns if c != key) for r in df.collect()}


@pytest.fixture(scope="module")
def hills(spark):
    rng = random.Random(1)
    return lattice(spark, [rng.randrange(2, 100, 2) for _ in range(7 * 6)], 7)


def test_drainage_forms_agree(hills):
    cells, edges = hills
    want = values(serial.per_map(cells, edges, serial.drainage, serial.DRAINAGE).drop("map_id"))
    filled = N.flood(cells, edges)
    flow = N.flow_direction(filled, edges)
    flux = N.accumulate(flow, cells)
    assert values(filled.join(flow, "cell_id").join(flux, "cell_id").select("cell_id", "filled", "to", "flux")) == want
    heights = {r.cell_id: r.height for r in cells.collect()}
    assert all(f >= heights[i] for i, (f, _, _) in want.items())
    assert all(to == -1 or want[to][0] < f for f, to, _ in want.values())
    rain = sum(r.precip for r in cells.collect())
    assert sum(q for _, to, q in want.values() if to == -1) == rain


def test_region_and_distance_forms_agree(hills):
    cells, edges = hills
    cells = cells.withColumn("band", F.expr("height div 25"))
    got = values(N.regions(cells, edges, "band"))
    assert values(serial.per_map(cells, edges, lambda c, near: serial.label(c, near, "band"), "map_id long, cell_id long, kind long, region long").drop("map_id")) == got
    for lowest in (-10, -1):
        far = values(N.distance_field(cells, edges, lowest))
        assert values(serial.per_map(cells, edges, lambda c, near, low=lowest: serial.coast_distance(c, near, low), "map_id long, cell_id long, distance long").drop("map_id")) == far


def test_rivers_end_in_larger_ones(hills):
    cells, edges = hills
    d = serial.per_map(cells, edges, serial.drainage, serial.DRAINAGE).drop("map_id")
    r = N.rivers(d.select("cell_id", "to"), d.select("cell_id", "flux"), 4)
    rows, flux, to = values(r), {i: v[2] for i, v in values(d).items()}, {i: v[1] for i, v in values(d).items()}
    assert set(rows) == {i for i, q in flux.items() if q >= 4}
    for i, (river, parent) in rows.items():
        assert flux[i] >= flux[river] or i == river
        if to[i] in rows and rows[to[i]][0] != river:
            assert parent == rows[to[i]][0]


def test_distance_field(spark):
    heights = [30] * 49
    for i in (0, 1, 2, 7, 8, 9):
        heights[i] = 10
    cells, edges = lattice(spark, heights, 7)
    got = {i: v[0] for i, v in values(N.distance_field(cells, edges)).items()}
    water = [i for i, h in enumerate(heights) if h < 20]
    far = lambda i, group: min(abs(i % 7 - j % 7) + abs(i // 7 - j // 7) for j in group)
    land = [i for i in range(49) if i not in water]
    assert got == {i: far(i, water) if i in land else -far(i, land) for i in range(49)}


@pytest.mark.parametrize("height", [10, 30])
def test_one_medium(spark, height):
    cells, edges = lattice(spark, [height] * 9, 3)
    assert set(values(N.distance_field(cells, edges)).values()) == {(0,)}
    f = N.features(cells, N.regions(cells.withColumn("land", F.col("height") >= 20), edges, "land")).collect()
    assert [(r.feature, r.n_cells) for r in f] == [("ocean" if height < 20 else "island", 9)]


def test_ring_island_has_a_lake(spark):
    heights = [10] * 49
    for i in (16, 17, 18, 23, 25, 30, 31, 32):
        heights[i] = 40
    cells, edges = lattice(spark, heights, 7)
    f = N.features(cells, N.regions(cells.withColumn("land", F.col("height") >= 20), edges, "land")).collect()
    assert sorted((r.feature, r.n_cells) for r in f) == [("island", 8), ("lake", 1), ("ocean", 40)]


def test_lone_cell_and_no_edges(spark):
    cells, edges = lattice(spark, [50], 1)
    none = edges.limit(0)
    assert values(N.flood(cells, none)) == {0: (50,)}
    assert values(N.flow_direction(N.flood(cells, none), none)) == {0: (-1,)}
    assert N.regions(cells, none, "height").collect()[0].region == 0
    assert spatial.radius_join(cells.limit(0), cells, 2).count() == 0


def test_expansion_forms_agree(hills):
    cells, edges = hills
    costs = cells.select("map_id", "cell_id", F.when(F.col("height") >= 20, 5 + F.col("height")).alias("cost"))
    seeds = {10: 2, 25: 1, 31: 3}
    spark = cells.sparkSession
    s = spark.createDataFrame(list(seeds.items()), "cell_id long, owner long")
    got = values(N.expand(s, costs, edges, 300))
    given = costs.select("map_id", "cell_id", F.col("cost").cast("double").alias("cost")).join(s.withColumnRenamed("owner", "seed"), "cell_id", "left")
    want = values(serial.per_map(given, edges, lambda c, near: serial.spread(c, near, 300), "map_id long, cell_id long, cost long, owner long").drop("map_id"))
    assert got == want and len(got) > 10
    # owners of any size keep their names
    large = {c: o + 2**40 for c, o in seeds.items()}
    far = values(N.expand(spark.createDataFrame(list(large.items()), "cell_id long, owner long"), costs, edges, 300))
    assert far == {c: (cost, o + 2**40) for c, (cost, o) in got.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, pairs):
    part = {i: i for p in pairs for i in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == part


def test_long_chain_and_hub(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    hub = spark.range(1000, 1400).select(F.col("id").alias("src"), F.lit(999).cast("long").alias("dst"))
    got = connected_components(chain.union(hub)).groupBy("component").count().collect()
    assert sorted((r.component, r["count"]) for r in got) == [(0, 201), (999, 401)]


def test_gather_downstream(spark):
    flow = spark.createDataFrame([(i, i + 1 if i < 40 else None, 1) for i in range(41)], "node long, to long, amount long")
    assert {r.node: r.total for r in gather_downstream(flow).collect()} == {i: i + 1 for i in range(41)}


def test_spaced_choice_is_greedy(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 30), rng.uniform(0, 30), rng.randrange(20)) for i in range(80)]
    taken = []
    for p in sorted(points, key=lambda p: (p[3], p[0])):
        if all(math.dist(p[1:3], q[1:3]) >= 5 for q in taken):
            taken.append(p)
    got = spacing.spaced(spark.createDataFrame(points, "id long, x double, y double, rank long"), 5.0)
    assert {r.id for r in got.collect()} == {p[0] for p in taken}


def test_radius_and_nearest_join(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(40)]
    b = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)]
    left, right = (spark.createDataFrame(r, "id long, x double, y double") for r in (a, b))
    near = {(p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) <= 2.5}
    assert {(r.id, r.id_r) for r in spatial.radius_join(left, right, 2.5).collect()} == near
    assert {(r.id, r.id_r) for r in spatial.radius_join(left, right, 2.5, "left").collect() if r.id_r is not None} == near
    assert {r.id for r in spatial.radius_join(left, right, 2.5, "left_semi").collect()} == {i for i, _ in near}
    assert {r.id for r in spatial.radius_join(left, right, 2.5, "left_anti").collect()} == {p[0] for p in a} - {i for i, _ in near}
    top = {(p[0], q[0]) for p in a for q in sorted((q for q in b if math.dist(p[1:], q[1:]) <= 2.5), key=lambda q: math.dist(p[1:], q[1:]))[:2]}
    assert {(r.id, r.id_r) for r in spatial.nearest(left, right, "id", "id", 2, 2.5).collect()} == top
    with pytest.raises(ValueError):
        spatial.radius_join(left, right, 0)


def test_radius_join_is_an_equi_join(spark):
    a = spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    plan = spatial.radius_join(a, a, 2)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_geometry(spark):
    square, line = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(0.0, 0.0), (3.0, 4.0), (3.0, 5.0)]
    d = spark.createDataFrame([(square, line)], "ring array<struct<x:double,y:double>>, line array<struct<x:double,y:double>>")
    c = F.col("ring")
    r = d.select(G.ring_area2(c).alias("a"), G.ring_centroid(c).alias("m"), G.line_length(F.col("line")).alias("l"), G.ring_contains(c, F.lit(1.0), F.lit(1.0)).alias("i"), G.ring_contains(c, F.lit(5.0), F.lit(1.0)).alias("o"), G.wkt_line(F.col("line")).alias("w"), G.line_length(F.slice("line", 1, 1)).alias("z")).first()
    assert (r.a, tuple(r.m), r.l, r.i, r.o, r.z) == (16.0, (2.0, 1.0), 6.0, True, False, 0.0)
    assert r.w == "LINESTRING(0.0 0.0,3.0 4.0,3.0 5.0)"


def _blown(line, strength):
    """(cell, rain) that one wind leaves, step by step."""
    out, air = {}, strength - line[0][1]
    for i, (cell, h, t) in enumerate(line if air > 0 else []):
        nxt = line[i + 1] if i + 1 < len(line) else None
        if t < -5:
            continue
        if h < 20:
            if nxt and nxt[1] >= 20:
                out[nxt[0]] = out.get(nxt[0], 0) + int(max(air / 15, 1))
            elif nxt:
                air = min(air + 5, strength)
                out[cell] = out.get(cell, 0) + 5
        elif not nxt:
            out[cell] = out.get(cell, 0) + int(air)
        else:
            passable = nxt[1] <= 85
            fall = min(max(air / 10, 1) + max(nxt[1] - h, 0) * (nxt[1] / 70) ** 2, air) if passable else air
            out[cell] = out.get(cell, 0) + int(fall)
            air = max(0, air - fall + (1 if fall > 1.5 else 0)) if passable else 0
    return out


def test_wind_against_steps(spark):
    rng = random.Random(41)
    lines = {f"l{k}": [(100 * k + i, rng.choice([5, 15, 25, 40, 60, 80, 95]), rng.choice([10, 10, 10, -9])) for i in range(rng.randrange(1, 40))] for k in range(30)}
    strength = {k: rng.choice([3.0, 60.0, 120.0, 255.0]) for k in lines}
    rows = [(k, i, c, h, t, strength[k]) for k, line in lines.items() for i, (c, h, t) in enumerate(line)]
    got = N.wind(spark.createDataFrame(rows, "line string, place long, cell_id long, height long, temperature long, strength double")).groupBy("cell_id").agg(F.sum("rain").alias("rain"))
    want = {}
    for k, line in lines.items():
        want |= _blown(line, strength[k])
    assert {r.cell_id: r.rain for r in got.collect()} == {c: r for c, r in want.items() if r}
    schema = "line string, place long, cell_id long, height long, temperature long, strength double"
    for segment, upto in ((9, 40), (1, 6)):  # lines of many segments give the same
        short = spark.createDataFrame([r for r in rows if r[1] < upto], schema)
        assert sorted(map(tuple, N.wind(short, segment=segment).collect())) == sorted(map(tuple, N.wind(short).collect()))
    peak = dict(_blown(list(zip(range(6), [10, 10, 30, 90, 30, 30], [9] * 6, strict=True)), 100.0))
    assert peak[2] > 50 and peak.get(4, 0) == 0


def test_lines_cross_a_box(spark):
    rows = {1: [(0, 0), (10, 10)], 2: [(0, 9), (9, 0)], 3: [(0, 5), (1, 5)], 4: [(5, 5)], 5: [(0, 0), (3, 20), (9, 20)], 6: [(7, 0), (7, 20)], 7: [(8, 0), (8, 20)], 8: [(0, 11), (11, 0)], 9: [(0, 13), (13, 0)]}
    d = spark.createDataFrame([(k, i, x, y) for k, line in rows.items() for i, (x, y) in enumerate(line)], "river_id long, seq long, x long, y long")
    assert {r.river_id for r in spatial.lines_in_box(d, "river_id", (4, 4, 7, 7)).collect()} == {1, 2, 4, 6, 8, 9}


def test_versions_and_reuse(spark, tmp_path):
    from cartoweave import session

    path = str(tmp_path / "w")
    d = lambda n: spark.createDataFrame([(1, i, i, i) for i in range(n)], "map_id long, cell_id long, x long, y long")
    for k in range(1, 12):
        store.save_world({"cells": d(k)}, path, f"v{k}")
    assert store.versions(spark, path)[-2:] == ["v10", "v11"] and store.scan(spark, path, "cells", 1).count() == 11
    store.save_world({"cells": d(5)}, path, "v3")  # saved again: replaced, and the last one
    store.save_world({"cells": d(5)}, path, "v3")
    assert store.versions(spark, path)[-1] == "v3" and store.scan(spark, path, "cells", 1).count() == 5
    big = spark.createDataFrame([(1, i, i * 50, 3) for i in range(20)], "map_id long, cell_id long, x long, y long")
    store.save_world({"cells": big}, path, "w")
    got = store.scan(spark, path, "cells", 1, (90, 0, 210, 9))
    assert sorted(r.x for r in got.collect()) == [100, 150, 200] and "square_x" not in got.columns
    assert re.search(r"PartitionFilters: \[[^\]]*square_x", got._jdf.queryExecution().toString())
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    folder = str(tmp_path / "r")
    assert session.reuse(spark, folder, {"a": 1}, make).count() == session.reuse(spark, folder, {"a": 1}, make).count() == 3 and len(made) == 1
    (marker,) = (tmp_path / "r").glob("*/_SUCCESS")
    marker.unlink()  # not written whole
    assert session.reuse(spark, folder, {"a": 1}, make).count() == 3 and len(made) == 2


def test_spacing_shrinks_until_enough(spark):
    d = spark.createDataFrame([(i, i % 5, i // 5, i) for i in range(25)], "id long, x long, y long, rank long")
    taken, radius = spacing.spaced_enough(d, 3.0, 20)
    assert radius == pytest.approx(3.0 / 1.2**3) and taken.count() < 20
    taken, radius = spacing.spaced_enough(d, 3.0, 3)
    assert radius == 3.0 and taken.count() >= 3


def test_colours_against_the_library(spark):
    import colorsys

    from cartoweave.operators import names as names_

    rng = random.Random(42)
    rows = [(i, *(f"#{rng.randrange(2**24):06x}" for _ in range(2))) for i in range(60)] + [(90, "#000000", "#ffffff"), (91, "#808080", "#ff0000")]
    for share, more in ((0.25, 0.4), (0.5, 0.0), (0.65, -0.3)):
        got = {r.id: r.c for r in spark.createDataFrame(rows, "id long, a string, b string").select("id", names_.hsv_mix(F.col("a"), F.col("b"), share, more).alias("c")).collect()}
        for i, a, b in rows:
            (h1, s1, v1), (h2, s2, v2) = (colorsys.rgb_to_hsv(*(int(c[k : k + 2], 16) / 255 for k in (1, 3, 5))) for c in (a, b))
            if abs(h1 - h2) > 0.5:
                h1, h2 = (h1, h2 + 1) if h1 > h2 else (h1 + 1, h2)
            s, v = s1 * share + s2 * (1 - share), v1 * share + v2 * (1 - share)
            if more > 0:
                v, s = min(1, v * (1 + more)), max(0.1, s * (1 - more * 0.2))
            elif more < 0:
                v, s = max(0.1, v * (1 + more)), min(1, s * (1 - more * 0.2))
            want = colorsys.hsv_to_rgb((h1 * share + h2 * (1 - share)) % 1, s, v)
            assert all(abs(int(got[i][1 + 2 * k : 3 + 2 * k], 16) - want[k] * 255) <= 1.001 for k in range(3))


def test_edit_fold(spark):
    cells = spark.createDataFrame([(1, 30), (2, 40), (3, 50)], "cell_id long, height long")
    log = spark.createDataFrame([(1, 1, "adjust_height", -50), (2, 1, "adjust_height", 7), (3, 2, "set_height", 5), (4, 2, "adjust_height", 3), (5, 2, "noop", 9)], "edit_id long, cell_id long, op string, delta long")
    assert values(D.fold_heights(cells, log)) == {1: (7,), 2: (8,), 3: (50,)}
    up = D.upsert(cells, spark.createDataFrame([(2, None), (3, 1), (9, 2)], "cell_id long, height long"), "cell_id")
    assert values(up) == {1: (30,), 2: (40,), 3: (1,), 9: (2,)}
    assert values(D.remove(cells, spark.createDataFrame([(1,)], "cell_id long"), "cell_id")) == {2: (40,), 3: (50,)}


def test_reroute(spark):
    rows = spark.createDataFrame([(r, s, s, s) for r in (1, 2) for s in range(4)], "river_id long, seq long, x long, y long")
    new = spark.createDataFrame([(2, 0, 0, 0), (2, 1, 3, 4)], rows.schema)
    paths = D.ordered_path(D.reroute(rows, new), "river_id")
    got = {r.river_id: r.n for r in paths.select("river_id", G.line_length(F.col("path")).alias("n")).collect()}
    assert got == {1: pytest.approx(3 * 2**0.5), 2: 5.0}


def test_owner_passes(spark):
    cells, edges = lattice(spark, [30] * 25, 5)
    owners = cells.select("cell_id", F.when(F.col("cell_id") == 12, 2).otherwise(1).cast("long").alias("s"))
    assert {v[0] for v in values(N.vote(owners, edges, "s")).values()} == {1}
    assert {v[0] for v in values(N.absorb_small(owners, edges, "s", 2)).values()} == {1}


def test_alea_repeats():
    a, b = generator.Alea("seed"), generator.Alea("seed")
    run = [a.random() for _ in range(200)]
    assert run == [b.random() for _ in range(200)] and len(set(run)) == 200
    assert all(0 <= v < 1 for v in run) and 0.4 < sum(run) / 200 < 0.6
    assert generator.Alea("other").random() != run[0]


@pytest.mark.parametrize("template", sorted(generator.TEMPLATES))
def test_templates_make_worlds(template):
    one, two = (generator.Heightmap(24, 18, 5) for _ in range(2))
    for line in generator.TEMPLATES[template]:
        one.run(*line.split())
        two.run(*line.split())
    assert (one.h == two.h).all() and 0 <= one.h.min() and one.h.max() <= 100 and len(set(one.h)) > 3


def test_heightmap_worlds(spark):
    maps = spark.createDataFrame([(1, "atoll", 3), (2, "atoll", 3), (3, "volcano", 4)], "map_id long, template string, seed long")
    rows = generator.heightmaps(maps, 12, 10).collect()
    by = {m: [r.height for r in sorted(rows, key=lambda r: r.cell_id) if r.map_id == m] for m in (1, 2, 3)}
    assert len(by[1]) == 120 and by[1] == by[2] != by[3]


def test_uniform(spark):
    rows = spark.range(2000).select(generator.uniform(3, F.col("id")).alias("u")).collect()
    assert all(0 <= r.u < 1 for r in rows) and 0.45 < sum(r.u for r in rows) / 2000 < 0.55


def test_names(spark):
    bases = spark.createDataFrame([(1, "Alanor, Belinda,,Marton , Kolberg"), (2, "")], "base int, names string")
    split = names.split_names(bases)
    assert sorted(r.name for r in split.collect()) == ["Alanor", "Belinda", "Kolberg", "Marton"]
    s = split.select("name", names.syllables(F.col("name")).alias("s")).collect()
    assert all("".join(r.s) == r.name.lower() for r in s)
    chain = names.transitions(split)
    rows = spark.createDataFrame([(i, 1) for i in range(40)] + [(99, 7)], "id long, base int")
    one, two = ({r.id: r.name for r in names.walk_names(rows, chain).collect()} for _ in range(2))
    assert one == two and all(1 <= len(n) <= 12 for i, n in one.items() if i < 99) and one[99] == ""
    d = spark.createDataFrame([("maria",), ("kolberg",), ("new york",), ("bookkeeper-'",)], "n string")
    r = [tuple(x) for x in d.select(names.with_suffix(F.col("n"), F.lit("ia")), names.state_name(F.col("n")), names.code(F.col("n")), names.tidy(F.col("n"))).collect()]
    assert r[0][0] == "mariia" and r[1][1] == "kol" and r[2][1:3] == ("newyork", "NY") and r[3][3] == "Bokeper"


def test_store(spark, tmp_path):
    d = spark.createDataFrame([(m, i, i % 5, i // 5) for m in (1, 2) for i in range(20)], "map_id long, cell_id long, x long, y long")
    store.save_world({"cells": d, "maps": d.select("map_id", F.lit("m").alias("name")).distinct()}, str(tmp_path), "v1")
    assert store.versions(spark, str(tmp_path)) == ["v1"]
    got = store.scan(spark, str(tmp_path), "cells", 2, (1, 1, 3, 2))
    plan = got._jdf.queryExecution().toString()
    assert got.count() == 6 and re.search(r"PartitionFilters: \[isnotnull\(map_id", plan) and "PushedFilters: [IsNotNull(x)" in plan
    with pytest.raises(ValueError):
        store.scan(spark, str(tmp_path), "users", 1)
    store.save_world({"cells": store.forget(spark, str(tmp_path), "v1", "cells", 1)}, str(tmp_path), "v2")
    assert store.scan(spark, str(tmp_path), "cells", 1).count() == 0
    sizes = {r.folder: r.n for r in store.file_sizes(spark, f"{tmp_path}/{store.pin(spark, str(tmp_path), 'v1')['tables']['cells']}").collect()}
    assert set(sizes) == {"square_y=0"}
    # a version that no manifest names is not seen
    d.write.partitionBy("map_id").parquet(str(tmp_path / "v3" / "cells"))
    assert store.versions(spark, str(tmp_path)) == ["v1", "v2"]


def test_streams_equal_batches(spark, sf, tmp_path):
    from cartoweave.sources import tables as T

    events = T.table(spark, sf, "events").repartition(4).withColumn("event_id", F.col("event_id"))
    events.write.parquet(str(tmp_path / "in"))
    stream = edit_log.read_edits(spark, str(tmp_path / "in"), T.count_cells(spark, sf))
    batch = T.edits(spark, sf)
    for name, f in (("latest_rows", edit_log.latest_by_cell), ("activity_rows", lambda d: edit_log.activity(d, late="60 days")), ("session_rows", lambda d: edit_log.sessions(d, late="60 days"))):
        got = edit_log.drain(f(stream), name).collect()
        want = f(batch).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
    edit_log.keep_current(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(repr, edit_log.current(spark, str(tmp_path / "state")).collect())) == sorted(map(repr, edit_log.latest_by_cell(batch).collect()))


def test_worlds_without_sql(spark, sf):
    from cartoweave import queries as Q

    assert Q.QUERIES["heightmap_worlds"](spark, sf).count() == 5 * 1200
    assert Q.QUERIES["generated_names"](spark, sf).where("name = ''").count() == 0
    s = {r.id for r in Q.QUERIES["spaced_capitals"](spark, sf).collect()}
    from cartoweave.sources import tables as T

    at = {r.id: (r.x, r.y) for r in T.settlements(spark, sf).collect()}
    assert all(math.dist(at[a], at[b]) >= 6 for a, b in itertools.combinations(s, 2))


def test_names_of_large_chains(spark, monkeypatch):
    chain = spark.createDataFrame([(b, p, n, k) for b in (1, 2) for p, n, k in (("", "ka", 3), ("", "mo", 1), ("ka", "ri", 2), ("ka", "", 1), ("mo", "ka", 1), ("ri", "mo", 2), ("ri", "", 2))], "base int, prev string, next string, n long")
    rows = spark.range(300).select("id", (F.col("id") % 3 + 1).cast("int").alias("base"))  # base 3 has no chain
    want = {r.id: r.name for r in names.walk_names(rows, chain).collect()}
    monkeypatch.setattr(names, "CHAIN_ROWS", 3)
    assert {r.id: r.name for r in names.walk_names(rows, chain).collect()} == want and len(set(want.values())) > 5


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_land_and_water(spark, sf):
    from cartoweave.queries import QUERIES
    from cartoweave.sources import tables as T

    assert QUERIES["all_land_and_water"](spark, sf).select("cell_id").distinct().count() == T.count_cells(spark, sf)


def test_ranks_have_no_cap(spark):
    from cartoweave.plans.ranks import ranked

    rng = random.Random(5)
    rows = [(i, rng.randrange(40)) for i in range(5000)]
    got = ranked(spark.createDataFrame(rows, "id long, v long").repartition(7), F.desc("v"), F.col("id")).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted((r.place, r.id, r.v) for r in got) == [(k + 1, i, v) for k, (i, v) in enumerate(want)]
    assert ranked(spark.createDataFrame([], "id long"), F.col("id")).count() == 0


def test_ordered_queries_are_whole(spark, sf):
    from cartoweave.queries import QUERIES
    from cartoweave.sources import tables as T

    rivers = [(-r.discharge, r.river_id) for r in QUERIES["rivers_by_discharge"](spark, sf).collect()]
    assert rivers == sorted(rivers) and len(rivers) == T.table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    for name, n in (("ranked_land", T.cells(spark, sf).where("height >= 20").count()), ("ranked_cells", T.count_cells(spark, sf))):
        assert [r.place for r in QUERIES[name](spark, sf).collect()] == list(range(1, n + 1))


def test_closest_has_no_radius(spark):
    rng = random.Random(6)
    a = [(i, rng.uniform(-9, 9) ** 3, rng.uniform(-9, 9)) for i in range(30)] + [(30, 5000.0, -4000.0)]
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(a[:25], "id long, x double, y double")
    for k in (2, 24, 30):
        got = {(r.id, r.place): r.id_r for r in spatial.closest(left, right, "id", "id", k, 0.5, F.col("id") != F.col("id_r")).collect()}
        want = {(p[0], n + 1): q[0] for p in a for n, q in enumerate(sorted((q for q in a[:25] if q[0] != p[0]), key=lambda q: (math.dist(p[1:], q[1:]), q[0]))[:k])}
        assert got == want
    assert spatial.closest(left, right.limit(0), "id", "id", 2, 0.5).count() == spatial.closest(left.limit(0), right, "id", "id", 2, 0.5).count() == 0


def test_expansion_by_owner(hills):
    import heapq

    cells, edges = hills
    seeds = {10: (2, 1.0), 25: (1, 4.0), 31: (3, 2.0)}
    s = cells.sparkSession.createDataFrame([(c, o, p) for c, (o, p) in seeds.items()], "cell_id long, owner long, push double")
    got = values(N.expand_by_owner(s, cells.select("cell_id", "height"), edges.select("src", "dst"), 10 + F.col("height") / F.col("push"), 150))
    height, near = {r.cell_id: r.height for r in cells.collect()}, {}
    for e in edges.collect():
        near.setdefault(e.src, []).append(e.dst)
    want = {}
    for c, (o, push) in seeds.items():
        heap, done = [(0.0, c)], set()
        while heap:
            d, i = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            want[i] = min(want.get(i, (math.inf, 0)), (d, o))
            for j in near[i]:
                if j not in seeds and d + 10 + height[j] / push <= 150:
                    heapq.heappush(heap, (d + 10 + height[j] / push, j))
    assert got == want and len({o for _, o in want.values()}) == 3


def test_separate_lakes_of_one_level(spark):
    wide = 11
    low = {12, 13, 14, 16, 18, 19, 20, 38}
    heights = [30 if i in low else 60 if 0 < i % wide < 10 and 0 < i // wide < 4 else 50 for i in range(wide * 5)]
    cells, edges = lattice(spark, heights, wide)
    cells, edges = cells.drop("map_id").withColumn("precip", F.lit(100).cast("long")), edges.drop("map_id")
    filled = N.flood(cells, edges)
    flow = N.flow_direction(filled, edges)
    d = cells.join(filled, "cell_id").join(flow, "cell_id").join(N.accumulate(flow, cells), "cell_id").withColumn("kind", N.lake_kind())
    found = N.lakes(d, N.regions(d, edges, "kind"), edges).collect()
    assert sorted((r.lake, r.level, r.n_cells, r.outlet) for r in found) == [(12, 50, 3, 12), (18, 50, 3, 18)]


def test_short_rivers_go(spark, sf):
    from cartoweave.queries import QUERIES

    flow = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, -1), (7, 4), (9, -1)], "cell_id long, to long")
    flux = spark.createDataFrame([(1, 50), (2, 60), (3, 70), (4, 150), (7, 20), (9, 30)], "cell_id long, flux long")
    assert {r.river_id for r in N.rivers(flow, flux, 10).collect()} == {1, 7, 9}
    assert values(N.rivers(flow, flux, 10, 3)) == {i: (1, None) for i in (1, 2, 3, 4)}
    assert all(r.n_cells >= 3 for r in QUERIES["long_rivers"](spark, sf).collect())


def test_dealt_edges_are_shuffled_once(spark):
    """Rounds of a fixpoint shuffle what improved, and not the edges."""
    from cartoweave.plans.fixpoint import dealt

    edges = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    held = dealt(edges, "src")
    assert spark.conf.get("spark.sql.adaptive.enabled") == before and held.count() == 100
    front = spark.range(5).select(F.col("id").alias("node")).hint("merge")
    plan = front.join(held, front.node == held.src)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
