"""Colours and coloured sweeps, against a serial pass."""

from __future__ import annotations

import random
from collections import Counter

from cartoweave.operators import sweeps


def test_sweeps_equal_the_serial_pass(spark):
    rng = random.Random(6)
    n, ids = 90, rng.sample(range(10**6), 90)
    pairs = {(a, b) for _ in range(220) for a, b in [rng.sample(ids, 2)]}
    pairs |= {(b, a) for a, b in pairs}
    near = {i: sorted(b for a, b in pairs if a == i) for i in ids}
    owner = {i: rng.choice([0, 1, 1, 2, 3]) for i in ids}
    fixed = {i: rng.random() < 0.2 for i in ids}
    place = lambda i: (i * sweeps.FACTOR % sweeps.MODULUS, i)
    colour: dict = {}
    for i in sorted(ids, key=place):
        used = {colour[j] for j in near[i] if j in colour}
        colour[i] = next(c for c in range(n) if c not in used)
    cells = spark.createDataFrame([(i, owner[i], fixed[i]) for i in ids], "cell_id long, owner long, fixed boolean")
    edges = spark.createDataFrame(sorted(pairs) + sorted(pairs)[:5], "src long, dst long")
    got = sweeps.colours(cells, edges).checkpoint()
    assert {r.cell_id: r.colour for r in got.collect()} == colour and all(colour[a] != colour[b] for a, b in pairs)
    edges, serial = edges.distinct(), dict(owner)
    for i in sorted(ids, key=lambda i: (colour[i], i)):
        votes = Counter(serial[j] for j in near[i] if serial[j] > 0)
        top = min(votes, key=lambda o: (-votes[o], o), default=0)
        if serial[i] > 0 and not fixed[i] and votes[serial[i]] < 2 and votes[top] >= 2:
            serial[i] = top
    assert {r.cell_id: r.owner for r in sweeps.swept(cells, edges, "owner", got).collect()} == serial != owner
    assert sweeps.colours(cells.limit(0), edges.limit(0)).count() == sweeps.swept(cells.limit(0), edges.limit(0), "owner", got.limit(0)).count() == 0
    assert {r.colour for r in sweeps.colours(cells, edges.limit(0)).collect()} == {0}
