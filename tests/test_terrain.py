"""Heightmap programs on a graph that is no lattice, against a serial one that goes ring by ring."""

from __future__ import annotations

import random

import pytest

from cartoweave.operators import terrain
from cartoweave.plans import blocks

PROGRAM = ["Hill 3 60-90 20-80 20-80", "Range 2 30-50 10-40 20-80", "Strait 2 vertical 0 0", "Add 4 10-60 0 0", "Trough 2 20-30 15-85 20-80", "Pit 2 10-20 20-80 20-80", "Multiply 0.9 land 0 0", "Smooth 3 0 0 0", "Invert 1 x 0 0", "Hill 1.5 20-30 10-90 10-90", "Mask -2 0 0 0"]


def serial(site: dict, near: dict, seed: int, power: float, line_power: float) -> dict:
    xs, ys = [p[0] for p in site.values()], [p[1] for p in site.values()]
    box = x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    noise = terrain.noise
    at = lambda x, y: min(site, key=lambda i: (((site[i][0] - x) ** 2 + (site[i][1] - y) ** 2) ** 0.5, i))
    kept = lambda v: round(max(0.0, min(100.0, v)), 6)
    h = dict.fromkeys(site, 0.0)
    commands, blobs = terrain.drawn(PROGRAM, seed)
    for run in terrain.runs(commands):
        name, *a = commands[run[0]]
        amounts: dict = {}
        for b in (b for b in blobs if b.seq in run):
            for t in range(b.tries):
                px, py = (lo + (hi - lo) * (z[0] + (z[1] - z[0]) * noise(b.seed, 2 * t + k)) / 100 for k, (lo, hi, z) in enumerate(((x0, x1, b.x), (y0, y1, b.y))))
                start = at(px, py)
                if b.kind in ("Range", "Strait") or (h[start] + b.top <= 90 if b.kind == "Hill" else h[start] >= 20):
                    break
            else:
                if b.kind == "Hill":
                    continue
            path = [start]
            if b.line:
                ex, ey = terrain._end(b, box, px, py)
                d = lambda i: (site[i][0] - ex) ** 2 + (site[i][1] - ey) ** 2  # noqa: B023, E731
                while ways := [j for j in near[path[-1]] if d(j) < d(path[-1])]:
                    path.append(min(ways, key=lambda j: (d(j) * (0.5 if noise(b.seed + 1, j) > 0.85 else 1), j)))  # noqa: B023
            grown, ring, hops = {i: 0 if b.line else b.top for i in path}, list(path), 0
            rings = b.rings(line_power)
            while ring:
                for i in ring:
                    was = amounts.setdefault((b.seq, i), 0.0)
                    line = rings[hops] * (0.85 + 0.3 * noise(b.seed, i)) if b.kind in ("Range", "Trough") else grown[i]
                    amounts[b.seq, i] = 0.9 - 0.1 / b.width * (b.width - max(hops, 1) + 1) if b.kind == "Strait" else was + (line if b.kind in ("Hill", "Range") else -line)
                ahead: dict = {}
                for i in ring if not b.line or hops < b.reach(line_power) else []:
                    for j in near[i]:
                        if j not in grown:
                            ahead[j] = max(ahead.get(j, 0), int(grown[i] ** power * (0.9 + 0.2 * noise(b.seed, j))) if grown[i] > 1 else 0)
                grown |= ahead
                ring, hops = list(ahead), hops + 1
        for seq in run if name in terrain.GROWING else []:
            for i in site:
                v = amounts.get((seq, i), 0.0)
                h[i] = kept((h[i] ** v if v > 0 else h[i]) if commands[seq][0] == "Strait" else h[i] + v)
        if name == "Add":
            h = {i: kept(v + 4 if 10 <= v <= 60 else v) for i, v in h.items()}
        elif name == "Multiply":
            h = {i: kept((v - 20) * 0.9 + 20 if v >= 20 else v) for i, v in h.items()}
        elif name == "Smooth":
            h = {i: kept((h[i] * 2 + (h[i] + sum(h[j] for j in near[i])) / (len(near[i]) + 1)) / 3) for i in site}
        elif name == "Invert":
            h = {i: h[at(x0 + x1 - site[i][0], site[i][1])] for i in site}
        elif name == "Mask":
            n = {i: (2 * (x - x0) / (x1 - x0) - 1, 2 * (y - y0) / (y1 - y0) - 1) for i, (x, y) in site.items()}
            h = {i: kept((h[i] + h[i] * (1 - (1 - n[i][0] ** 2) * (1 - n[i][1] ** 2))) / 2) for i in site}
    return {i: int(v) for i, v in h.items()}


@pytest.mark.parametrize("seed", [5])
def test_programs_equal_the_serial_one(spark, monkeypatch, seed):
    monkeypatch.setattr(blocks, "FEWEST", 150)  # several blocks, so that blobs and walkers cross cuts
    rng = random.Random(seed)
    wide, high = 14, 11
    ids = rng.sample(range(5000), wide * high)
    site = {ids[y * wide + x]: (x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3)) for y in range(high) for x in range(wide)}
    pairs = {(ids[y * wide + x], ids[(y + b) * wide + x + a]) for y in range(high) for x in range(wide) for a, b in ((1, 0), (0, 1), (1, 1)) if x + a < wide and y + b < high}
    pairs |= {(b, a) for a, b in pairs}
    near = {i: sorted(b for a, b in pairs if a == i) for i in ids}
    cells = spark.createDataFrame([(i, *p, None) for i, p in site.items()], "cell_id long, x double, y double, h string")
    edges = spark.createDataFrame([*sorted(pairs), *sorted(pairs)[:9]], "src long, dst long")
    got = {r.cell_id: r.height for r in terrain.heights(cells, edges, PROGRAM, seed, 1000).collect()}
    assert got == serial(site, near, seed, 0.93, 0.75)
    assert len(set(got.values())) > 15


def test_edge_cases(spark):
    none = spark.createDataFrame([], "cell_id long, x double, y double")
    no_edges = spark.createDataFrame([], "src long, dst long")
    assert terrain.heights(none, no_edges, PROGRAM, 1).count() == 0
    alone = spark.createDataFrame([(3, 1.0, 1.0)], "cell_id long, x double, y double")
    assert [r.height for r in terrain.heights(alone, no_edges, ["Hill 1 40 0-100 0-100", "Smooth 2 0 0 0", "Add 2 all 0 0"], 1).collect()] == [42]
    with pytest.raises(ValueError, match="unknown command"):
        terrain.drawn(["Hills 1 2 3 4"], 1)


def test_hills_go_no_farther_than_their_heights(spark, monkeypatch):
    """A lattice of 3 by 400 in 16 blocks: a low hill at one end touches few of them, and one that starts again and again as it is alive comes to the same."""
    monkeypatch.setattr(blocks, "FEWEST", 100)
    wide, n = 3, 1200
    cells = spark.range(n).selectExpr("id AS cell_id", f"id % {wide} AS x", f"id div {wide} AS y").checkpoint()
    edges = spark.createDataFrame([(a, b) for i in range(n) for j in ([i + 1] if i % wide < wide - 1 else []) + ([i + wide] if i + wide < n else []) for a, b in ((i, j), (j, i))], "src long, dst long")
    touched, rounds = [], blocks.rounds

    def counted(*args):
        touched.append((found := rounds(*args)).count())
        return found

    monkeypatch.setattr(blocks, "rounds", counted)
    grown = lambda: {r.cell_id: r.height for r in terrain.heights(cells, edges, ["Hill 1 40 0-100 0-1", "Pit 1 10 0-100 0-1", "Add 2 all 0 0"], 3, 1000).collect()}
    monkeypatch.setattr(terrain, "HOPS", 10**6)
    want = grown()
    assert touched == [16] and max(want.values()) > 20
    monkeypatch.setattr(terrain, "HOPS", 64)
    assert grown() == want
    assert len(touched) == 2 and touched[1] <= 3
    monkeypatch.setattr(terrain, "HOPS", 2)
    assert grown() == want
    assert len(touched) > 3 and max(touched[2:]) <= 3
