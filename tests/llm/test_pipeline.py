"""The stages of corpus_pipeline against brute force on the smallest tables."""

from __future__ import annotations

import collections

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from cartoweave.llm import decontaminate, line_dedup, packing, quality_rules  # noqa: E402
from cartoweave.llm.common import table  # noqa: E402


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    given = {r.doc_id: r for r in docs.collect()}
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        out.append({r.doc_id: r for r in docs.collect()} if i < 4 else docs.collect())
    rules, lines, near, clean, packed = out
    want = {i: quality_rules.judge(r.text) for i, r in given.items()}
    assert {i: r.text for i, r in rules.items()} == {i: j[8] for i, j in want.items() if j[6]}
    assert all(r.n_chars == len(r.text) and r.lang == given[i].lang for i, r in rules.items())

    holders = collections.defaultdict(set)
    for i, r in rules.items():
        for x in r.text.split("\n"):
            if len(line_dedup.line_key(x)) >= 10:
                holders[line_dedup.line_key(x)].add(i)
    kept = {}
    for i, r in rules.items():
        text = "\n".join(x for x in r.text.split("\n") if not (len(h := holders.get(line_dedup.line_key(x), ())) > 1 and min(h) < i))
        if text == r.text or text.encode().split():
            kept[i] = text
    assert {i: r.text for i, r in lines.items()} == kept

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own = {i: shingles(t or "") for i, t in kept.items()}
    part = {i: i for i in own}
    root = lambda i: i if part[i] == i else root(part[i])
    ids = sorted(own)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            if own[x] == own[y] or len(own[x] & own[y]) >= 0.8 * len(own[x] | own[y]):
                low, high = sorted((root(x), root(y)))
                part[high] = low
    assert set(near) == {i for i in ids if root(i) == i}

    # the operators' own SQL, which is brute force, over the stages' inputs
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2/*.parquet'")
    leaks = con.execute(f"SELECT doc_id, contaminated FROM ({decontaminate.SQL})").fetchall()
    assert set(clean) == {i for i, bad in leaks if not bad} and len(leaks) == len(near)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/3/*.parquet'")
    want = con.execute(f"SELECT doc_id, piece, start, n_tokens, bucket_len, batch, slot FROM ({packing.SQL})").fetchall()
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, r.n_tokens, r.bucket_len, r.batch, r.slot) for r in packed)


def test_stages_of_edges(spark, sf):
    """Nulls, empty texts, repeated rows and an empty table pass through every stage; what has no text goes at the first."""
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, text, None, None, None), (1, text, "en", "s", 5), (None, text + " more.", "en", "s", 5), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, "\n\n", "en", None, 2)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
        kept = sorted(docs.select("doc_id", "text").collect(), key=repr)
        assert [(r.doc_id, r.text) for r in kept] == ([(1, text), (1, text), (None, text + " more.")] if given else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(kept)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
