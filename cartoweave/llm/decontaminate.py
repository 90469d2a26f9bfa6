"""Operator 3: benchmark decontamination by a BM25 index with block-max WAND.

Test items are indexed: for each term its postings, in blocks of items, with BM25 weights.  A
weight is divided by its item's full score (that of a passage holding all of the item's
terms), so one threshold serves long and short items.  Items are told apart by length, in
classes of CLASS * 4^k words; for each class, every document is cut into passages of twice the
class's length that overlap by half, so that each item lies in one whole; each passage is a
query.  Items whose normalised score reaches THRESHOLD are retrieved by block-max WAND, for
many passages at once.  A passage's terms are put in order of their bounds; those before the
pivot cannot reach SKIP of the threshold together, so only blocks in postings from the pivot on
are looked at, all others are skipped.  A block goes on if its terms' maxima in the block, and the
bounds of those before the pivot, reach the threshold, and then if all its maxima do; only of
the blocks that are left the postings are read and the items scored.  A retrieved item is
verified by its overlap with the passage: at least SIMILARITY of the question's and of the
answer's five-word shingles must be in it.

Words are lower-cased (A-Z), ASCII punctuation is blank.  An item's answer follows its last
"answer:", or else is its last line or sentence; an item of one sentence is all question.  A part
of fewer than five words must be there in one run.

The index is built by tasks, in shards of about SHARD_BYTES of items, and SHARDS of them are
broadcast for each scan, so their size is bounded whatever the number of items; document
frequencies and the mean length are of all items.  Documents are never shuffled; each scan hands
them on to the next.  A passage's arrays are bounded by WORK, whatever its length.

Null and empty texts are clean; items without a word match nothing.  Repeated rows each get a
row, repeated items the least item_id of equal texts each count as themselves.  Rows of a null
doc_id get a row.  Other columns are not read.  Without items every document is clean.
"""

from __future__ import annotations

import pickle
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import sliced, table
from cartoweave.plans.components import ensure_checkpoint_dir

K1, B = 1.2, 0.75
THRESHOLD, SIMILARITY, WORDS = 0.5, 0.8, 5
#: Items of a posting block; bytes of items in a shard, and shards that are held in one scan of the documents.
ITEMS, SHARD_BYTES, SHARDS = 4, 2 << 20, 4
#: Words of the first class of items; numbers in an array of the search.
CLASS, WORK = 64, 1 << 19
#: Share of the threshold that the terms before the pivot may reach: the less, the tighter are the blocks' bounds.
SKIP = 0.2
_TABLE = bytes.maketrans(string.punctuation.encode() + string.ascii_uppercase.encode(), b" " * len(string.punctuation) + string.ascii_lowercase.encode())
_ANSWER = re.compile(r"(?is)^(.*)\banswer\s*:(.*)$")
_LAST = re.compile(r"(?s)^(.*(?:[.!?](?=\s)|\n))(.*\S.*)$")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def question_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    text = (text or "").strip()
    m = _ANSWER.match(text) or _LAST.match(text)
    q, a = (words_of(m[1]), words_of(m[2])) if m else (words_of(text), [])
    return (q, a) if q else (a, [])


def shingles(words: list[bytes]) -> set[tuple]:
    return {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()


def overlap(part: list[bytes], passage: list[bytes], held: set[tuple]) -> float:
    """Share of the part's shingles that the passage holds; of a part of fewer words, 1 if they are there in one run."""
    if not part:
        return 1.0
    if len(part) < WORDS:
        n = len(part)
        return float(any(passage[i : i + n] == part for i in range(len(passage) - n + 1)))
    own = shingles(part)
    return len(own & held) / len(own)


def passage_size(words: int) -> int:
    """Twice the length of the class of an item of so many words."""
    size = CLASS
    while size < words:
        size *= 4
    return 2 * size


def _expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of places: which range, and the place."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Part:
    """Postings of a shard's items of one class; statistics are those of all items."""

    def __init__(self, items: list[tuple], passage: int, frequency: dict[bytes, int], n_items: int, mean: float):
        self.items, self.passage = items, passage
        self.terms: dict[bytes, int] = {}
        rows = []
        for k, (_, q, a) in enumerate(items):
            words = q + a
            weights = {}
            for w, f in Counter(words).items():
                df = frequency[w]
                idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
                weights[w] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean))
            full = sum(weights.values())
            rows.extend((self.terms.setdefault(w, len(self.terms) + 1), k, v / full) for w, v in weights.items())
        self.blocks = -(-len(items) // ITEMS)
        term, item = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        weight = np.array([r[2] for r in rows])
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order], weight[order]
        key = term * self.blocks + self.item // ITEMS
        #: By term and block: a key, the first posting (and the end of the last), the largest weight.
        self.key, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key))
        self.most = np.maximum.reduceat(self.weight, first)
        #: By term, 0 being any word that no item has: its first block, and its largest weight.
        self.start = np.searchsorted(self.key, np.arange(len(self.terms) + 2) * self.blocks)
        self.bound = np.zeros(len(self.terms) + 1)
        np.maximum.at(self.bound, term, self.weight)

    def postings(self, term: int) -> list[tuple[int, float]]:
        a, b = self.first[self.start[term]], self.first[self.start[term + 1]]
        return list(zip(self.item[a:b].tolist(), self.weight[a:b].tolist(), strict=True))

    def retrieve(self, words: list[bytes]):
        """(passage start, item numbers) for each passage that retrieves any."""
        get = self.terms.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return
        n, size = len(ids), self.passage
        step = size // 2
        starts = np.arange(0, max(1, n - size + step), step)
        chunk = max(1, min(128, WORK // max(size, self.blocks)))
        for c in range(0, len(starts), chunk):
            s = starts[c : c + chunk]
            at = s[:, None] + np.arange(min(size, n))
            own = np.where(at < n, ids[np.minimum(at, n - 1)], 0)
            own.sort(1)
            own[:, 1:][own[:, 1:] == own[:, :-1]] = 0
            found: dict[int, list[int]] = {}
            for p, item in self.search(own):
                found.setdefault(p, []).append(item)
            for p in sorted(found):
                yield int(s[p]), sorted(found[p])

    def search(self, own: np.ndarray):
        """(row, item) for rows of distinct terms (0: none) and the items whose scores over them reach the threshold."""
        least = THRESHOLD - 1e-9
        live = np.flatnonzero(self.bound[own].sum(1) >= least)
        own = own[live]
        bound = self.bound[own]
        order = np.argsort(bound, axis=1)
        order = order[:, np.count_nonzero(bound, 1).max(initial=0) * -1 :]  # words that no item has come first
        own, bound = np.take_along_axis(own, order, 1), np.take_along_axis(bound, order, 1)
        before = np.cumsum(bound, 1) < SKIP * least  # all that stand before the pivot
        low = np.where(before, bound, 0).sum(1)
        row, place = np.nonzero(~before & (own > 0))
        term = own[row, place]
        which, at = _expanded(self.start[term], self.start[term + 1] - self.start[term])
        block = self.key[at] - term[which] * self.blocks
        reach = np.bincount(row[which] * self.blocks + block, self.most[at], len(own) * self.blocks).reshape(len(own), self.blocks)
        rows, blocks = np.nonzero((reach > 0) & (reach + low[:, None] >= least))
        some = max(1, WORK // max(1, own.shape[1]))
        for i in range(0, len(rows), some):
            r, b = rows[i : i + some], blocks[i : i + some]
            key = own[r] * self.blocks + b[:, None]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = (own[r] > 0) & (self.key[at] == key)
            there &= (np.where(there, self.most[at], 0).sum(1) >= least)[:, None]
            c, place = np.nonzero(there)
            at = at[c, place]
            which, posting = _expanded(self.first[at], self.first[at + 1] - self.first[at])
            score = np.bincount(c[which] * ITEMS + self.item[posting] % ITEMS, self.weight[posting], len(r) * ITEMS).reshape(-1, ITEMS)
            for x, k in zip(*np.nonzero(score >= least), strict=True):
                yield int(live[r[x]]), int(b[x]) * ITEMS + int(k)

    def leaks(self, words: list[bytes], out: set[int]) -> None:
        """Adds the item_ids whose question and answer a passage of the words holds."""
        for start, found in self.retrieve(words):
            passage = words[start : start + self.passage]
            held = shingles(passage) if len(passage) >= WORDS else set()
            for k in found:
                i, q, a = self.items[k]
                if i not in out and overlap(q, passage, held) >= SIMILARITY and overlap(a, passage, held) >= SIMILARITY:
                    out.add(i)


class Index:
    """A shard of items, by classes of length."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], n_items: int, mean: float):
        by_size = defaultdict(list)
        for i, t in items:
            q, a = question_answer(t)
            if q:
                by_size[passage_size(len(q) + len(a))].append((i, q, a))
        self.parts = [Part(by_size[size], size, frequency, n_items, mean) for size in sorted(by_size)]

    def leaks(self, words: list[bytes]) -> set[int]:
        out: set[int] = set()
        for part in self.parts:
            part.leaks(words, out)
        return out


def _terms(items: DataFrame) -> DataFrame:
    """(shard, term, n): each item's distinct words; and a row (shard, null, number of words) of each item that has any."""

    def count(batches):
        for b in sliced(batches):
            for shard, text in zip(b.column("shard").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    terms = [w.decode("utf-8", "surrogatepass") for w in set(words)]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * (len(terms) + 1), pa.int32()), pa.array([*terms, None], pa.string()), pa.array([0] * len(terms) + [len(words)], pa.int64())], ["shard", "term", "n"])

    return items.select("shard", "text").mapInArrow(count, "shard int, term string, n long")


def indexes(items: DataFrame):
    """Broadcast lists of at most SHARDS indexes of shards of items (item_id, text)."""
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    shards = -(-int(size) // SHARD_BYTES)
    if not shards:
        return
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    rows = _terms(items).checkpoint()
    n, total = rows.where("term IS NULL").agg(F.count("*"), F.sum("n")).first()
    if not n:
        return
    frequency = rows.where("term IS NOT NULL").groupBy("term").count()
    known = rows.where("term IS NOT NULL").select("shard", "term").distinct().join(frequency, "term")

    def build(own: pa.Table, terms: pa.Table) -> pa.Table:
        df = {w.encode("utf-8", "surrogatepass"): k for w, k in zip(terms.column("term").to_pylist(), terms.column("count").to_pylist(), strict=True)}
        own = own.sort_by([("item_id", "ascending"), ("text", "ascending")])
        index = Index(list(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist(), strict=True)), df, n, total / n)
        return pa.table({"shard": own.column("shard")[:1], "data": pa.array([pickle.dumps(index)], pa.binary())})

    built = items.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(build, "shard int, data binary").checkpoint()
    for start in range(0, shards, SHARDS):
        held = built.where(F.col("shard").between(start, start + SHARDS - 1)).orderBy("shard").collect()  # of some SHARD_BYTES of items each
        yield spark.sparkContext.broadcast([pickle.loads(r.data) for r in held])


def _all_leaks(held: list[Index], text: str | None) -> set[int]:
    words = words_of(text)
    return set().union(*(index.leaks(words) for index in held))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, contaminated, item_ids; items: item_id, text.

    The scans of several shards hand the text on, so that documents are never shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<long>").alias("item_ids"))
    for held in indexes(items):

        def run(batches, held=held):
            for b in sliced(batches):
                found = [sorted({*old, *_all_leaks(held.value, t)}) for t, old in zip(b.column("text").to_pylist(), b.column("item_ids").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "item_ids"])

        rows = rows.mapInArrow(run, "doc_id long, text string, item_ids array<long>")
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, all columns, less the rows that hold a benchmark item."""
    for held in indexes(items):

        def run(batches, held=held):
            for b in sliced(batches):
                yield b.filter(pa.array([not _all_leaks(held.value, t) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",").alias("item_ids"))


_P = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_TO = " " * 32 + string.ascii_lowercase


def _tokens(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_P}{string.ascii_uppercase}', '{_TO}'), '[^\\x20\\x09-\\x0D]+')"


_SIZE = "CASE " + " ".join(f"WHEN len(q0) + len(a0) <= {CLASS * 4**k} THEN {2 * CLASS * 4**k}" for k in range(12)) + " END"
#: Brute force: every passage against every item that shares a shingle with it.
SQL = rf"""
WITH i0 AS (SELECT DISTINCT item_id, trim(text, e' \t\n\x0b\x0c\r') AS t FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT item_id, t, CASE WHEN regexp_matches(t, '(?is)^.*\banswer\s*:.*$') THEN '(?is)^(.*)\banswer\s*:(.*)$' ELSE '(?s)^(.*(?:[.!?]\s|\n))(.*\S.*)$' END AS p FROM i0),
i2 AS (SELECT item_id, CASE WHEN regexp_matches(t, p) THEN {_tokens("regexp_extract(t, p, 1)")} ELSE {_tokens("t")} END AS q0,
  CASE WHEN regexp_matches(t, p) THEN {_tokens("regexp_extract(t, p, 2)")} ELSE [] END AS a0 FROM i1),
items AS (SELECT row_number() OVER () AS k, item_id, {_SIZE} AS w, CASE WHEN len(q0) > 0 THEN q0 ELSE a0 END AS q, CASE WHEN len(q0) > 0 THEN a0 ELSE [] END AS a FROM i2 WHERE len(q0) + len(a0) > 0),
parts AS (SELECT k, 'q' AS part, q AS ws FROM items UNION ALL SELECT k, 'a', a FROM items WHERE len(a) > 0),
sh AS (SELECT DISTINCT k, part, array_to_string(ws[j:j + 4], ' ') AS s FROM (SELECT k, part, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS j FROM parts WHERE len(ws) >= 5)),
need AS (SELECT k, part, count(*) AS n FROM sh GROUP BY k, part),
d AS (SELECT row_number() OVER () AS r, doc_id, {_tokens("coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT r, w, unnest(range(0, greatest(1, len(ws) - w + w // 2), w // 2)) AS s FROM d, (SELECT DISTINCT w FROM items)),
dg AS (SELECT r, array_to_string(ws[j:j + 4], ' ') AS s, j - 1 AS at FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS j FROM d)),
hits AS (SELECT dg.r, dg.at, sh.k, sh.part, sh.s FROM dg JOIN sh USING (s)),
hp AS (SELECT h.r, st.s AS p, h.k, h.part, count(DISTINCT h.s) AS n FROM hits h JOIN items USING (k) JOIN starts st ON st.r = h.r AND st.w = items.w WHERE h.at >= st.s AND h.at + 5 <= st.s + st.w GROUP BY ALL),
ok AS (SELECT hp.r, p, hp.k, hp.part FROM hp JOIN need USING (k, part) WHERE hp.n >= 0.8 * need.n),
few AS (SELECT k, part, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM parts WHERE len(ws) BETWEEN 1 AND 4),
other AS (SELECT k, part FROM parts),
cand AS (SELECT DISTINCT r, p, k FROM ok),
psg AS (SELECT c.r, c.p, c.k, ' ' || array_to_string(d.ws[c.p + 1:c.p + items.w], ' ') || ' ' AS t FROM cand c JOIN d USING (r) JOIN items USING (k)),
short AS (SELECT psg.r, psg.p, psg.k, few.part FROM psg JOIN few ON few.k = psg.k AND contains(psg.t, few.s)),
met AS (SELECT r, p, k, part FROM ok UNION SELECT r, p, k, part FROM short),
full_ AS (SELECT r, p, k FROM met GROUP BY r, p, k HAVING count(*) = (SELECT count(*) FROM parts o WHERE o.k = met.k)),
res AS (SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM full_ JOIN items USING (k) GROUP BY r)
SELECT d.doc_id, res.ids IS NOT NULL AS contaminated, coalesce(array_to_string(res.ids, ','), '') AS item_ids FROM d LEFT JOIN res USING (r)
"""
