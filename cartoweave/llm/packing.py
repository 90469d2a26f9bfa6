"""Operator 4: packing into length buckets of least padding.

Texts are cut into pieces of at most max_len tokens.  The global histogram of piece lengths
(max_len + 1 numbers at most, whatever the input) goes to the driver, where dynamic
programming chooses the `buckets` boundaries that minimise the padding of all pieces.  Inside
a bucket, pieces in order of doc_id and piece form batches of as many as fit the token budget
when padded to the boundary.

A bucket may hold a third of all pieces, so places in a bucket are never counted in one task:
pieces are dealt by ranges of doc_id, each task counts its own, and the offsets of the ranges
(ranges times buckets numbers) are added.

A token is a maximal run outside [\\x20\\x09-\\x0D], or what the tokenizer file given as a
parameter makes of the text.  Null and empty texts, and texts without a token, are one piece
of length 0, in the first bucket.  Rows with a null doc_id come first.  Repeated rows each
give pieces; ties of doc_id and piece are ordered by length.  Other columns are not read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoweave.llm.common import parts_for, sliced, table
from cartoweave.plans.components import ensure_checkpoint_dir

MAX_LEN, BUCKETS, TOKEN_BUDGET = 2048, 8, 16384
#: Offsets of ranges that are broadcast, of three numbers each; more are joined by a shuffle of the pieces.
BROADCAST_ROWS = 1_000_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries that minimise the sum of (boundary - length) over all pieces; on ties the lower previous boundary."""
    if not len(lengths):
        return []
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(lengths)
    before = np.concatenate([[0], np.cumsum(counts)])
    # best[j]: least number of tokens, padding included, of the j shortest lengths
    best = np.where(np.arange(n + 1) == 0, 0, np.iinfo(np.int64).max // 4)
    back = []
    for _ in range(min(buckets, n)):
        new, last = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (before[j] - before[:j])
            last[j] = cost.argmin()
            new[j] = cost[last[j]]
        best = new
        back.append(last)
    out, j = [], n
    for last in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(last[j])
    return out[::-1]


def pieces(docs: DataFrame, max_len: int = MAX_LEN, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens: whole texts, in pieces of at most max_len tokens."""

    def run(batches):
        count = None
        for b in sliced(batches):
            if tokenizer and count is None:
                from tokenizers import Tokenizer

                model = Tokenizer.from_file(tokenizer)
                model.encode_special_tokens = True
                count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
            texts = b.column("text").to_pylist()
            n = np.array([(count(t) if count else len(t.encode("utf-8", "surrogatepass").split())) if t else 0 for t in texts], np.int64)
            k = np.maximum(1, -(-n // max_len))
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * max_len
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece), pa.array(start), pa.array(np.minimum(n[row] - start, max_len))], ["doc_id", "piece", "start", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece long, start long, n_tokens long")


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket_len, batch, slot: a row for each piece."""
    ensure_checkpoint_dir(docs.sparkSession)
    # four numbers a piece, far less than the text: partitions sized by the text are small.  Written first, as
    # ranges are sampled from them: texts are tokenised once
    ranges = parts_for(docs, 512 << 20)
    dealt = pieces(docs, max_len, tokenizer).checkpoint().repartitionByRange(ranges, "doc_id", "piece").sortWithinPartitions("doc_id", "piece", "n_tokens")

    def number(batches):
        part = TaskContext.get().partitionId()
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "part", "at"])
            at += b.num_rows

    fixed = dealt.mapInArrow(number, "doc_id long, piece long, start long, n_tokens long, part int, at long").checkpoint()
    hist = fixed.groupBy("n_tokens").count().collect()  # at most max_len + 1 rows
    cuts = boundaries(np.array([r[0] for r in hist], np.int64), np.array([r[1] for r in hist], np.int64), buckets)
    bucket_of = F.lit(None).cast("long")
    for cut in reversed(cuts):
        bucket_of = F.when(F.col("n_tokens") <= cut, F.lit(cut).cast("long")).otherwise(bucket_of)
    placed = fixed.withColumn("bucket_len", bucket_of)
    sizes = placed.groupBy("part", "bucket_len").agg(F.count("*").alias("n"))
    before = sizes.select("part", "bucket_len", F.coalesce(F.sum("n").over(Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", "bucket_len").orderBy("at")) - 1
    # ranges times buckets rows
    joined = placed.withColumn("own", own).join(F.broadcast(before) if ranges * buckets <= BROADCAST_ROWS else before, ["part", "bucket_len"])
    at, room = F.col("before") + F.col("own"), F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    return joined.select("doc_id", "piece", "start", "n_tokens", "bucket_len", F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rounds = ["b0 AS (SELECT 0 AS j, 0::BIGINT AS cost, []::BIGINT[] AS cuts)"]
    for k in range(1, BUCKETS + 1):
        rounds.append(
            f"b{k} AS (SELECT j, cost, cuts FROM (SELECT h.j, b.cost + h.len * (h.upto - coalesce(p.upto, 0)) AS cost, list_append(b.cuts, h.len) AS cuts, "
            f"row_number() OVER (PARTITION BY h.j ORDER BY b.cost + h.len * (h.upto - coalesce(p.upto, 0)), b.j) AS o FROM h JOIN b{k - 1} b ON b.j < h.j LEFT JOIN h p ON p.j = b.j) WHERE o = 1)"
        )
    every = " UNION ALL ".join(f"SELECT {k} AS k, j, cost, cuts FROM b{k}" for k in range(1, BUCKETS + 1))
    return rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, i AS piece, i * {MAX_LEN} AS start, least(n - i * {MAX_LEN}, {MAX_LEN}) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(1, (n + {MAX_LEN - 1}) // {MAX_LEN}))) AS i FROM d)),
h AS (SELECT len, row_number() OVER (ORDER BY len) AS j, (sum(c) OVER (ORDER BY len))::BIGINT AS upto FROM (SELECT n_tokens AS len, count(*) AS c FROM p GROUP BY 1)),
{", ".join(rounds)},
best AS (SELECT cuts FROM ({every}) WHERE j = (SELECT max(j) FROM h) ORDER BY k = least({BUCKETS}, (SELECT count(*) FROM h)) DESC LIMIT 1),
q AS (SELECT doc_id, piece, start, n_tokens, list_min(list_filter(best.cuts, lambda c: c >= n_tokens)) AS bucket_len FROM p, best),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY doc_id NULLS FIRST, piece, n_tokens) - 1 AS spot, greatest(1, {TOKEN_BUDGET} // greatest(bucket_len, 1)) AS room FROM q)
SELECT doc_id, piece::BIGINT AS piece, start::BIGINT AS start, n_tokens::BIGINT AS n_tokens, bucket_len::BIGINT AS bucket_len, (spot // room)::BIGINT AS batch, (spot % room)::BIGINT AS slot FROM o
"""


SQL = _sql()
