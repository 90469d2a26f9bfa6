"""All labelled rows train, and all pairs of similar texts are linked."""

import random

from cartoweave.llm import kneser_ney, simhash


def test_labels_beyond_the_broadcast_all_count(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=80)), "en") for i in range(150)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    scores = lambda: sorted(tuple(r) for r in kneser_ney.classify(docs, labels).collect())
    whole = scores()
    monkeypatch.setattr(kneser_ney, "TRUSTED", 10)
    assert scores() == whole


def test_pipeline_keeps_no_similar_pair(spark, monkeypatch):
    """Around the bar, what is left once classes are made has no link between two classes; blocks of any size give the same."""
    rng = random.Random(12)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(120)]
        for _ in range(14):
            own = list(words)
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(120)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    similar = [(i, j) for i in sets for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for size in (simhash.SETS, 300):
        monkeypatch.setattr(simhash, "SETS", size)
        got = {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()}
        assert all(got[i] == got[j] for i, j in similar) and len(set(got.values())) > 6
        kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
        assert sorted(kept) == sorted(set(got.values()))
