"""Every world query against its SQL; the rest by their own properties."""

from __future__ import annotations

import pytest

from cartoweave import queries as Q


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, sf, duck, name):
    got = Q.QUERIES[name](spark, sf)
    want = duck.execute(Q.SQL[name])
    have = [d[0] for d in want.description]
    names = sorted(have)
    assert names == sorted(got.columns)
    at = [have.index(n) for n in names]
    rows = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    mine = sorted(repr([plain(r[n]) for n in names]) for r in got.collect())
    assert len(rows) == len(mine)
    assert rows == mine
