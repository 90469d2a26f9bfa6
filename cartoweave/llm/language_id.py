"""Operator 1: language identification by rank-order profiles.

A profile is the list of the PROFILE most frequent 1- to 3-grams of a language, by rank.  A
document's own most frequent n-grams are compared with each profile by the out-of-place
distance: the difference of the two ranks, or PROFILE where the profile lacks the n-gram.
The nearest language wins; ties go to the first name.  score is 1 - distance / the largest
distance that the document could have.

Text is lower-cased, everything but letters becomes one blank, and a blank is put at either
end.  An n-gram is its code points in 21-bit fields of one 64-bit integer, so the keys are
exact.  Counts are made per batch, merged by Spark, and ranked there: tasks hand on no more than
PROFILE types a language to the one that ranks it.  Only the profiles (PROFILE rows a language)
come to the driver, those of LANGUAGES languages at a time; more of them take as many passes over the documents.

Null or empty texts and texts without a letter: 'und', score 0.  No learned language (empty
table, or lang null throughout): 'und', score 0.  Equal counts rank by the n-gram's key.
Repeated rows each get a row, and each counts in training.  Columns other than doc_id, text
and lang are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoweave.llm.common import sliced, table
from cartoweave.plans import ranks as places
from cartoweave.plans.components import ensure_checkpoint_dir

PROFILE = 400
#: Languages whose profiles go to the tasks at a time; ISO 639-3 has some 8,000, so one pass is the rule.
LANGUAGES = 10_000
#: Keys that a training task gathers before it hands them on.
FLUSH = 1 << 20
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> str:
    """Lower case; each run of other characters than letters is one blank."""
    if not text:
        return ""
    out = _NOT_LETTERS.sub(" ", text.lower())
    if not out.isascii():  # \w also holds numerals that are neither letters nor in \d
        odd = [c for c in set(out) if c != " " and not c.isalpha()]
        if odd:
            out = " ".join(out.translate(dict.fromkeys(map(ord, odd), " ")).split())
    return out.strip()


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the 1- to 3-grams."""
    s = letters_only(text)
    if not s:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {s} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    keys = np.sort(np.concatenate([c[c != 32], two, three]))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys, ties by key."""
    return keys[np.lexsort((keys, -counts))[:most]]


def train_profiles(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, key, rank from 0) of rows with a lang: counts by batch, summed and ranked by Spark."""

    def count(batches):
        sums: dict[str, list] = {}
        held = 0

        def flush():
            for lang, parts in sums.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])

        for b in sliced(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                keys, n = grams(text)
                if len(keys):
                    sums.setdefault(lang, []).append((keys, n))
                    held += len(keys)
                if held > FLUSH:
                    merged = {}
                    for la, parts in sums.items():
                        k, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                        merged[la] = [(k, np.bincount(at, np.concatenate([x for _, x in parts])).astype(np.int64))]
                    sums, held = merged, sum(len(p[0][0]) for p in merged.values())
                    if held > FLUSH // 2:
                        yield from flush()
                        sums, held = {}, 0
        yield from flush()

    counts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, key long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    total = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # a bound on the bare row number lets every task drop all but its own first rows of a language before the shuffle
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile).withColumn("rank", F.col("rank") - 1)


def identify(docs: DataFrame, profiles: DataFrame, profile: int = PROFILE, at_a_time: int = LANGUAGES) -> DataFrame:
    """doc_id, lang_pred, score, and the other columns of docs but text."""
    ensure_checkpoint_dir(docs.sparkSession)
    profiles = profiles.select("lang", "key", "rank").checkpoint()  # small; learned once
    names = profiles.select("lang").distinct()
    blocks = [profiles]
    if (n := names.limit(at_a_time + 1).count()) > at_a_time:
        named = profiles.join(places.ranked(names, "lang"), "lang").withColumn("_block", F.floor((F.col("place") - 1) / at_a_time)).checkpoint()
        n = named.agg(F.max("place")).first()[0]
        blocks = [named.where(F.col("_block") == k) for k in range(-(-n // at_a_time))]
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    clash = {f.name.lower() for f in docs.schema.fields}
    lang, far, size = (next(c for c in (f"{x}{'_' * k}" for k in range(len(clash) + 1)) if c.lower() not in clash) for x in ("_lang", "_far", "_size"))
    out = docs
    for k, block in enumerate(blocks):
        out = out.mapInArrow(_nearest(block.select("lang", "key", "rank").collect(), profile, docs.columns, (lang, far, size), first=k == 0), f"{schema}, `{lang}` string, `{far}` long, `{size}` long")  # at_a_time * profile rows
    score = F.when(F.col(lang).isNull(), 0.0).otherwise(1 - F.col(far) / (F.lit(float(profile)) * F.col(size)))
    return out.select(*(F.col(f"`{f.name}`") for f in others), F.coalesce(F.col(lang), F.lit("und")).alias("lang_pred"), score.alias("score"))


def _nearest(rows: list, profile: int, columns: list[str], made: tuple[str, str, str], first: bool):
    """For mapInArrow: the nearest of some profiles (lang, key, rank), or the one found before, which wins ties; with its distance and the document's keys."""
    langs = sorted({r.lang for r in rows})
    number = {name: i for i, name in enumerate(langs)}
    key, which, rank = (np.array(c, np.int64) for c in (([r.key for r in rows]), [number[r.lang] for r in rows], [r.rank for r in rows]))
    order = np.argsort(key, kind="stable")
    keys, start, size = np.unique(key[order], return_index=True, return_counts=True)
    which, rank = which[order], rank[order]

    def one(text):
        k, n = grams(text)
        if not len(k) or not langs:
            return None, None, len(k)
        top = ranked(k, n, profile)
        at = np.minimum(np.searchsorted(keys, top), len(keys) - 1)
        own = np.flatnonzero(keys[at] == top)
        at = at[own]
        # the entries of all known keys, one after the other
        many = size[at]
        entry = np.repeat(start[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        nearer = np.bincount(which[entry], profile - np.abs(rank[entry] - np.repeat(own, many)), len(langs))
        best = int(nearer.argmax())
        return langs[best], profile * len(top) - int(nearer[best]), len(top)

    def run(batches):
        for b in sliced(batches):
            found = [one(t) for t in b.column("text").to_pylist()]
            if not first:
                before = zip(*(b.column(c).to_pylist() for c in made), strict=True)
                found = [x if y[0] is None or (x[0] is not None and x[1] < y[1]) else y for x, y in zip(found, before, strict=True)]
            made_ = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made_], [*columns, *made])

    return run


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles are learned from rows whose crc32(doc_id) mod 4 is not 2; lang, source and doc_id are no inputs of a prediction."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = train_profiles(docs.where(~held).select("lang", "text"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), profiles)


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) AS s,
  coalesce(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda a, x: CASE WHEN x < 256 THEN xor(a::BIGINT, x::BIGINT) ELSE xor(a::BIGINT >> 1, 3988292384 * (a::BIGINT & 1)) END) % 4 = 1, false) AS held_out FROM documents),
p AS (SELECT r, lang, held_out, string_split(' ' || s || ' ', '') AS c FROM d WHERE s <> ''),
q AS (SELECT r, lang, held_out, unnest(c) AS a, generate_subscripts(c, 1) AS i FROM p),
x AS (SELECT r, lang, held_out, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS e FROM q WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, lang, held_out, 1 AS n, a AS g FROM x WHERE a <> ' ' UNION ALL SELECT r, lang, held_out, 2, a || b FROM x WHERE b IS NOT NULL
  UNION ALL SELECT r, lang, held_out, 3, a || b || e FROM x WHERE e IS NOT NULL),
gc AS (SELECT r, any_value(lang) AS lang, any_value(held_out) AS held_out, n, g, count(*) AS k FROM g GROUP BY r, n, g),
tops AS (SELECT * FROM (SELECT r, n, g, row_number() OVER (PARTITION BY r ORDER BY k DESC, n, g) - 1 AS rk FROM gc) WHERE rk < {PROFILE}),
pc AS (SELECT lang, n, g, sum(k) AS k FROM gc WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, n, g),
prof AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY k DESC, n, g) - 1 AS rk FROM pc) WHERE rk < {PROFILE}),
langs AS (SELECT DISTINCT lang FROM prof),
far AS (SELECT t.r, l.lang, sum(coalesce(abs(t.rk - f.rk), {PROFILE})) AS far, count(*) AS m FROM tops t CROSS JOIN langs l LEFT JOIN prof f ON f.lang = l.lang AND f.g = t.g GROUP BY t.r, l.lang),
best AS (SELECT r, lang, 1 - far::DOUBLE / ({PROFILE} * m)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY far, lang) AS o FROM far) WHERE o = 1)
SELECT d.doc_id, d.held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(best.score, 0.0)::DOUBLE AS score FROM d LEFT JOIN best USING (r)
"""
