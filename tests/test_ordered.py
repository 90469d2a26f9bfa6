"""Edits in order, smooth ones in their place, against a serial fold."""

from __future__ import annotations

import random

from cartoweave.operators import edits


def test_smooth_in_its_place(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-20, 900), 24)
    pairs = {(a, b) for _ in range(30) for a, b in [rng.sample(ids[:16], 2)]}
    pairs |= {(b, a) for a, b in pairs}
    near = {i: sorted(b for a, b in pairs if a == i) for i in ids}
    base = {i: rng.randint(0, 100) for i in ids}
    hot = ids[0]
    # half of all edits are of one cell, smooth ones among them
    log = [(n * 3, rng.choice(["set_height", "adjust_height", "adjust_height", "adjust_height", "smooth", "noop"]), hot if rng.random() < 0.5 else rng.choice(ids), rng.randint(-60, 60)) for n in rng.sample(range(1000), 260)]
    odd = [(3001, "adjust_height", hot, None), (3004, "smooth", None, 1), (3007, "set_height", 5000, 1), (3010, "smooth", 5000, 1), (3013, "smooth", ids[-1], None)]
    h = {i: float(v) for i, v in base.items()}
    for _, op, c, d in sorted(log) + odd[-1:]:
        if op == "set_height":
            h[c] = max(float(d), 0.0)
        elif op == "adjust_height":
            h[c] = max(h[c] + d, 0.0)
        elif op == "smooth":
            h[c] = max(0.0, min(100.0, (h[c] + (h[c] + sum(h[j] for j in near[c])) / (1 + len(near[c]))) / 2))
    cells = spark.createDataFrame([(i, v, "x") for i, v in base.items()], "cell_id long, height int, delta string")
    rows = spark.createDataFrame(log + odd, "edit_id long, op string, cell_id long, delta long")
    edges = spark.createDataFrame([*pairs, *list(pairs)[:5], (hot, hot)], "src long, dst long")
    got = {r.cell_id: r.height for r in edits.fold_ordered(cells, rows, edges).collect()}
    assert got.keys() == h.keys() and all(abs(got[i] - h[i]) < 1e-6 for i in h)
    plain = {r.cell_id: r.height for r in edits.fold_ordered(cells, rows.where("op <> 'smooth'"), edges).collect()}
    assert plain == {r.cell_id: float(r.height) for r in edits.fold_heights(cells, rows).collect()}
    assert edits.fold_ordered(cells.limit(0), rows, edges).count() == 0
    assert {r.cell_id: r.height for r in edits.fold_ordered(cells, rows.limit(0), edges.limit(0)).collect()} == base


def _folded(base, log, pairs):
    """Heights after all edits (number, op, cell, delta), one by one."""
    h = {i: float(v) for i, v in base.items()}
    for _, op, c, d in sorted(log):
        near = [h[b] for a, b in pairs if a == c and b in h]
        h[c] = max(float(d), 0.0) if op == "set_height" else max(h[c] + d, 0.0) if op == "adjust_height" else max(0.0, min(100.0, (h[c] + (h[c] + sum(near)) / (1 + len(near))) / 2))
    return h


def _frames(spark, base, log, pairs):
    cells = spark.createDataFrame(list(base.items()), "cell_id long, height int")
    return cells, spark.createDataFrame(log, "edit_id long, op string, cell_id long, delta long"), spark.createDataFrame(pairs, "src long, dst long")


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, "")
    found = run()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    return found, jobs


def test_a_long_chain_of_smooth_edits_takes_few_jobs(spark):
    """Neighbours that are smoothed in turns 15 times: what the driver does and holds does not follow the chain."""
    base, pairs = {i: 7 * i % 90 for i in range(6)}, [(a, b) for i in range(5) for a, b in ((i, i + 1), (i + 1, i))]
    log = [(i, "smooth", (2, 3, 4)[i % 3], None) for i in range(15)] + [(100 + i, "adjust_height", i, -20) for i in range(6)] + [(200, "smooth", 2, None)]
    got, jobs = _jobs(spark, "chain", lambda: {r.cell_id: r.height for r in edits.fold_ordered(*_frames(spark, base, log, pairs)).collect()})
    want = _folded(base, log, pairs)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert jobs < 70


def test_smooth_edits_of_many_blocks(spark, monkeypatch):
    """Chains that go from block to block, a cell whose smooth edits are in several blocks, and a neighbour that is no cell."""
    monkeypatch.setattr(edits, "SMOOTH", 25)
    rng = random.Random(5)
    base = {i: rng.randint(0, 100) for i in range(30)}
    pairs = [(a, b) for i in range(30) for a, b in ((i, i + 1), (i + 1, i), (i, (i + 6) % 30), ((i + 6) % 30, i))]
    log = [(n, rng.choice(["set_height", "adjust_height", "smooth"]), rng.choice([13, rng.randrange(20)]), rng.randint(-60, 60)) for n in range(-30, 180)]
    got, jobs = _jobs(spark, "blocks", lambda: {r.cell_id: r.height for r in edits.fold_ordered(*_frames(spark, base, log, pairs)).collect()})
    want = _folded(base, log, pairs)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert jobs < 400
