"""Operator 12: importance resampling towards a target distribution over hashed features.

Features are runs of 1 to `longest` consecutive words, hashed to buckets.  The document-by-bucket
counts are written once, as blocks of compressed sparse rows: the ids of a block's documents,
the places where their entries start, the entries' buckets and counts.  Everything else reads
these blocks and no text:

1. Column sums: each task adds up its blocks in one array of `buckets` numbers, and tasks are
   added by bucket.  The target's texts give its sums in the same way.
2. A bucket's gain is 1000 times the log of the ratio of the two smoothed shares, floored.
   Gains are `buckets` numbers, whatever the input, and go to every task.
3. The product of the matrix with the gains, row by row, divided by the row's features, is a
   document's weight, floored.
4. Gumbel noise from a hash of the id is added; the `percent` % of the documents of at least
   `least_words` words with the highest scores are drawn, which is sampling without
   replacement in proportion to exp(weight / 1000).  Places are counted by ranges and offsets.

Words are runs outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased.  Null and
empty texts, and texts without a word, have no feature and weight 0.  A text of any length is
read in slices.  A null doc_id hashes as an empty one and comes after all others among equal
scores; repeated rows each have a row and a place of their own.  An empty table gives an
empty result; an empty target has even shares.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import shared_path, sliced, table
from cartoweave.plans.components import ensure_checkpoint_dir
from cartoweave.plans.ranks import ranked

LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Documents and entries of a block, and bytes of a text whose words are split at a time.
ROWS, ENTRIES, CHUNK = 4096, 1 << 20, 1 << 20
#: What is no sign of a word becomes a blank; A-Z are lower-cased.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCKS = "doc_ids array<long>, starts array<long>, n_words array<long>, cols binary, counts binary"


def feature_counts(text: str | None, longest: int, buckets: int) -> tuple[int, dict[int, int]]:
    """Number of words, and how often the text has features of each bucket."""
    found, n, tail = {}, 0, []
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_SIGNS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + CHUNK) if at + CHUNK < len(raw) else -1
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        at, n = end, n + len(words)
        # runs that end in this slice, also those that start in the one before
        joined = tail + words
        every = Counter(words)
        for k in range(2, longest + 1):
            first = max(0, len(tail) - k + 1)
            every.update(b" ".join(joined[i : i + k]) for i in range(first, len(joined) - k + 1))
        for feature, c in every.items():
            b = zlib.crc32(feature) % buckets
            found[b] = found.get(b, 0) + c
        tail = joined[-(longest - 1) :] if longest > 1 else []
    return n, found


def count_blocks(docs: DataFrame, id_column: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The document-by-bucket matrix: a row is a block of compressed sparse rows (columns BLOCKS; cols and counts are 32-bit)."""

    def block(ids, starts, n_words, cols, counts):
        data = [pa.array([x], t) for x, t in ((ids, pa.list_(pa.int64())), (starts, pa.list_(pa.int64())), (n_words, pa.list_(pa.int64())))]
        data += [pa.array([np.concatenate([np.empty(0, np.uint32), *x]).astype("<u4").tobytes()], pa.binary()) for x in (cols, counts)]
        return pa.RecordBatch.from_arrays(data, ["doc_ids", "starts", "n_words", "cols", "counts"])

    def run(batches):
        ids, starts, n_words, cols, counts = [], [0], [], [], []
        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).cast(pa.int64()).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = feature_counts(text, longest, buckets)
                col = np.fromiter(found, np.uint32, len(found))
                count = np.fromiter(found.values(), np.uint32, len(found))
                order = np.argsort(col)
                ids.append(doc_id), n_words.append(n), starts.append(starts[-1] + len(col)), cols.append(col[order]), counts.append(count[order])
                if len(ids) >= ROWS or starts[-1] >= ENTRIES:
                    yield block(ids, starts, n_words, cols, counts)
                    ids, starts, n_words, cols, counts = [], [0], [], [], []
        if ids:
            yield block(ids, starts, n_words, cols, counts)

    return docs.select(id_column, "text").mapInArrow(run, BLOCKS)


def _entries(block: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(block["cols"], "<u4"), np.frombuffer(block["counts"], "<u4").astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all blocks: `buckets` numbers."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for row in range(b.num_rows):
                cols, counts = _entries(b.slice(row, 1).to_pylist()[0])
                np.add.at(total, cols, counts)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("cols", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the raw share), each smoothed by one for every bucket."""
    k = float(len(raw))
    s, t = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(raw.astype(float), target.astype(float), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight: the product of the blocks with the gains, floored means."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                block = b.slice(row, 1).to_pylist()[0]
                cols, counts = _entries(block)
                starts = np.array(block["starts"], np.int64)
                total, n = (np.diff(np.concatenate([[0], np.cumsum(x)])[starts]) for x in (counts * gain[cols], counts))
                yield pa.RecordBatch.from_arrays([pa.array(block["doc_ids"], pa.int64()), pa.array(block["n_words"], pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))], [id_column, "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"{id_column} long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document; rank is null where it is not drawn."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "counts")
    count_blocks(docs, "doc_id", longest, buckets).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    gain = gains(column_sums(blocks, buckets), column_sums(count_blocks(target.withColumn("doc_id", F.lit(0).cast("long")), "doc_id", longest, buckets), buckets))
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((digits + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    # five numbers a document; written, as ranges are sampled from them
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words).checkpoint()
    drawn = scored.where("fit").count() * percent // 100
    places = ranked(scored, F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"))
    return places.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place")).cast("long").alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = ", ".join(["256"] * 8)
    octets = "list_transform(range(1, len(hex(encode(w))) + 1, 2), lambda i: ('0x' || substring(hex(encode(w)), i, 2))::BIGINT)"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform({octets}, lambda c: [c, {bits}]))), lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    return f"""
WITH r AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({lower}, {word}) AS ws FROM documents),
u AS (SELECT r, unnest(ws) AS w FROM r),
v AS (SELECT unnest(regexp_extract_all({lower}, {word})) AS w FROM benchmark),
b AS MATERIALIZED (SELECT w, ({crc} % {BUCKETS})::BIGINT AS bucket FROM (SELECT w FROM u UNION SELECT w FROM v)),
s AS (SELECT bucket, count(*) AS n FROM u JOIN b USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM v JOIN b USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM v) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, sum(gain) AS total FROM u JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
d AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / len(ws)), 0)::BIGINT AS weight,
  ('0x' || substring(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM r LEFT JOIN m USING (r)),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= {LEAST_WORDS} AS fit FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY fit) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM o
"""


SQL = _sql()
