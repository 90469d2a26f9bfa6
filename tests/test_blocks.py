"""Block-synchronous computations against serial ones, with many small blocks."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from cartoweave.plans import blocks

EDGE = "src long, dst long, w double, cap double"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "FEWEST", 12)


def graph(rng, n, m, cap=False):
    """Edges between near ids, some far, both ways."""
    out = []
    for _ in range(m):
        a = rng.randrange(n)
        b = min(n - 1, max(0, a + rng.randint(-6, 6))) if rng.random() < 0.9 else rng.randrange(n)
        w = float(rng.randint(0, 9))
        out += [(a, b, w, float(rng.randint(15, 40)) if cap else None), (b, a, w + 1, None)]
    return out


def serial(start, edges, how):
    best, heap = {}, [(v, o, n) for n, v, o in start]
    heapq.heapify(heap)
    near = {}
    for a, b, w, cap in edges:
        near.setdefault(a, []).append((b, w, cap))
    while heap:
        v, o, n = heapq.heappop(heap)
        if n in best and best[n] <= (v, o):
            continue
        best[n] = (v, o)
        for b, w, cap in near.get(n, ()):
            new = v + w if how == "add" else max(v, w)
            if cap is None or new <= cap:
                heapq.heappush(heap, (new, o, b))
    return best


@pytest.mark.parametrize("how", ["add", "max"])
@pytest.mark.parametrize("cap", [False, True])
def test_settle(spark, small, how, cap):
    rng = random.Random(len(how) + cap)
    edges = graph(rng, 150, 260, cap)
    start = [(rng.randrange(150), float(rng.randint(0, 5)), rng.randint(1, 9)) for _ in range(6)] + [(999, 1.0, 2), (999, 1.0, 1)]
    if how == "max":  # owners are compared where values add up
        start = [(n, v, 1) for n, v, _ in start]
    got = blocks.settle(spark.createDataFrame([*start, (5, None, 1)], "node long, value double, owner long"), spark.createDataFrame(edges, EDGE), how)
    assert {r.node: (r.value, r.owner) for r in got.collect()} == serial(start, edges, how)


def test_settle_of_nothing(spark):
    none = spark.createDataFrame([], EDGE)
    assert blocks.settle(spark.createDataFrame([], "node long, value double"), none).count() == 0
    assert [tuple(r) for r in blocks.settle(spark.createDataFrame([(3, 2.0)], "node long, value double"), none).collect()] == [(3, 2.0, 0)]


def test_own_blocks(spark):
    """Blocks by another rule than ranges, negative ids too."""
    edges = [(i, i + 1, 1.0, None) for i in range(-20, 20)]
    got = blocks.settle(spark.createDataFrame([(-20, 0.0)], "node long, value double"), spark.createDataFrame(edges, EDGE), block_of=lambda n: F.pmod(n, F.lit(7)))
    assert {r.node: r.value for r in got.collect()} == {i: float(i + 20) for i in range(-20, 21)}


def test_joined(spark, small):
    rng = random.Random(4)
    edges = [(a, b) for a, b, *_ in graph(rng, 300, 200)] + [(7, 7), (500, 501), (None, 3)]
    up = {}

    def top(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in blocks.joined(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: top(i) for i in up}
    one_way = spark.createDataFrame([(i + 1, i) for i in range(100)], "src long, dst long")
    assert {r.component for r in blocks.joined(one_way).collect()} == {0}


def test_gathered(spark, small):
    rng = random.Random(6)
    order = list(range(200))
    rng.shuffle(order)
    to = {n: order[rng.randrange(i)] if i and rng.random() < 0.95 else rng.choice([None, -1]) for i, n in enumerate(order)}
    amount = {n: rng.randint(-3, 9) for n in order}
    want = dict(amount)
    for n in order:
        at = to[n]
        while at is not None and at >= 0:
            want[at] += amount[n]
            at = to[at]
    got = blocks.gathered(spark.createDataFrame([(n, to[n], amount[n]) for n in order], "node long, to long, amount long"))
    assert {r.node: r.total for r in got.collect()} == want


def test_a_cycle_is_an_error(spark):
    with pytest.raises(Exception, match="cycle"):
        blocks.gathered(spark.createDataFrame([(0, 1, 1), (1, 0, 1)], "node long, to long, amount long")).collect()


def test_rounds_of_more_blocks_than_are_named(spark, monkeypatch):
    """Where some rounds have more active blocks than a plan names and others fewer, each block goes on from its last state."""
    monkeypatch.setattr(blocks, "FEWEST", 20)
    n = 120
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long, w double")
    start = spark.createDataFrame([(0, 0.0), (50, 60.0), (51, 0.0), (n - 1, 300.0)], "node long, value double")
    want = {i: float(min(i, abs(i - 51))) for i in range(n)}
    for named in (1, 2):
        monkeypatch.setattr(blocks, "NAMED", named)
        assert {r.node: r.value for r in blocks.settle(start, edges).collect()} == want
