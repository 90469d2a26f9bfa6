"""Operator 2: quality by an interpolated modified Kneser-Ney n-gram model.

The model is over signs, UTF-16 code units (runs of [\\x20\\x09-\\x0D] are one blank), so that no
word is unknown and the key of four signs is exact in 64 bits; a character above U+FFFF is two.
It is trained on trusted texts, those labelled quality 1.  A document's perplexity is held
against a threshold of its language: the upper Tukey fence, Q3 + FENCE * (Q3 - Q1), of the log
perplexities of trusted documents that the model wasn't trained on.  A text of n signs is allowed
SLACK / sqrt(n) more, three standard errors of a mean over n signs, so that short texts are not
rejected for their length.

1. Training counts of all n-grams of the corpus (0 where only other documents have them) are
   made by batch and summed by Spark: one row for each type.
2. Continuation counts, discounts, back-off weights and the interpolated probability of each
   type are count joins of tables of types, keyed by context and by suffix.
3. The model is cut into shards of about TYPES types, by the type's hash: their number follows
   the model, not the corpus.  Documents' n-grams are grouped by type in blocks of documents
   (a type's key once, then document and count) and dealt to shard and salt; every salt of a
   shard gets a copy of it.  Salts are dealt by block, and their number follows the corpus, so a
   type that all documents hold is spread over them.  What comes back is one number for each
   document and shard: it grows with the corpus alone.

All trusted rows train or set the threshold, however many: up to TRUSTED ids are broadcast, more are joined by a shuffle.

Null and empty texts and texts of white space have no n-gram: perplexity null, not kept.  A
language without MIN_TRUSTED held-out trusted documents takes the fence of all languages; null
lang counts as one.  Without trusted text nothing is judged: all documents with text are kept.
Repeated rows each get a row, and each train; a doc_id that has any label row of quality 1 is
trusted.  Quantiles are counted in bins of BIN, so ties share one.  Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoweave.llm.common import SLICE, bytes_of, crc_sql, mix64, sliced, table, tidy
from cartoweave.plans.components import ensure_checkpoint_dir

ORDER, FENCE, MIN_TRUSTED = 4, 3.0, 20
#: Three times the standard deviation of a character's log probability, some 1.5.
SLACK = 4.5
#: Signs of a block of documents; input bytes whose n-grams meet one copy of a shard; types of a shard (16 bytes each).
BLOCK, GROUP, TYPES = 2_000_000, 24 << 20, 1 << 18
#: Trusted ids that are broadcast at most (8 bytes each).
TRUSTED = 2_000_000
#: Width of the bins of log perplexity in which quantiles are counted.
BIN = 0.001


_RUNS = re.compile("[^ \\t-\\r]+")


def keys_of(text: str | None, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each sign and at the end of the text."""
    s = " ".join(_RUNS.findall(text)) if text else ""
    if not s:
        return np.empty(0, np.uint64)
    c = np.frombuffer((" " * (order - 1) + s + " ").encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    n = len(c) - order + 1
    key = c[:n].copy()
    for i in range(1, order):
        key = key << np.uint64(16) | c[i : i + n]
    return key


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def type_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, c): all n-grams of docs (text, trains), counted where trains is true."""

    def run(batches):
        held, size = [], 0

        def out(parts):
            keys, n = _summed(parts)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].astype(np.int64)), pa.array(n[i : i + 100_000])], ["key", "c"])

        for b in sliced(batches):
            for text, trains in zip(b.column("text").to_pylist(), b.column("trains").to_pylist(), strict=True):
                keys, n = counted(keys_of(text, order))
                if len(keys):
                    held.append((keys, n if trains else np.zeros(len(n), np.int64)))
                    size += len(keys)
                if size > 1 << 21:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield from out(held)
                        held, size = [], 0
        if held:
            yield from out(held)

    return docs.select("text", "trains").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(level: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts from the numbers of types seen once to four times."""
    n = [x or 0 for x in level.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


def probabilities(types: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, logp) for every row of types (key, c)."""
    levels = {order: types.where("c > 0")}
    for m in range(order - 1, 0, -1):
        levels[m] = levels[m + 1].select(F.col("key").bitwiseAND(F.lit((1 << 16 * m) - 1)).alias("key")).groupBy("key").agg(F.count("*").alias("c")).checkpoint()
    asked = {order: types.select("key")}
    for m in range(order - 1, 0, -1):
        asked[m] = asked[m + 1].select(F.col("key").bitwiseAND(F.lit((1 << 16 * m) - 1)).alias("key")).distinct()
    p = None
    for m in range(1, order + 1):
        d = _discounts(levels[m])
        c = F.col("c")
        less = F.when(c >= 3, c - d[2]).when(c == 2, c - d[1]).when(c == 1, c - d[0]).otherwise(0.0)
        saved = F.when(c >= 3, d[2]).when(c == 2, d[1]).otherwise(d[0])
        known = levels[m].select("key", less.alias("less"))
        if m == 1:
            total, back, signs = levels[1].agg(F.sum("c"), F.sum(saved), F.count("*")).first()
            uniform = 1.0 / (signs + 1)
            p = asked[1].join(known, "key", "left").select("key", ((F.coalesce("less", F.lit(0.0)) + F.lit(back * uniform)) / F.lit(float(total))).alias("p"))
        else:
            context = F.shiftrightunsigned("key", 16).alias("ctx")
            sums = levels[m].select(context, "c", saved.alias("saved")).groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("saved").alias("back"))
            rows = asked[m].withColumn("ctx", context).withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 16 * (m - 1)) - 1)))
            rows = rows.join(known, "key", "left").join(sums, "ctx", "left").join(p.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix")
            p = rows.select("key", F.when(F.col("total").isNull(), F.col("q")).otherwise((F.coalesce("less", F.lit(0.0)) + F.col("back") * F.col("q")) / F.col("total")).alias("p"))
    return p.select("key", F.log("p").alias("logp"))


_Z, _D = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unplaned(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """As _shard_column, of unsigned keys."""
    h = keys ^ (keys >> np.uint64(29)) ^ (keys >> np.uint64(13))
    return ((h & np.uint64((1 << 62) - 1)) % np.uint64(shards)).astype(np.int64)


def _shard_column(shards: int):
    k = F.col("key")
    return (k.bitwiseXOR(F.shiftrightunsigned(k, 29)).bitwiseXOR(F.shiftrightunsigned(k, 13)).bitwiseAND(F.lit((1 << 62) - 1)) % shards).cast("int")


def _pack_shard(keys, docs, counts) -> bytes:
    """Entries sorted by key and document: distinct keys' differences, entries a key, documents' differences, counts."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    own = np.diff(keys[first], prepend=np.uint64(0))
    sizes = np.diff(np.append(first, len(keys))).astype(np.uint32)
    step = docs.astype(np.int64)
    step[1:] -= np.where(new[1:], 0, step[:-1].copy())
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype(np.uint32)
    head = np.array([len(first), len(keys), len(large)], np.int64).tobytes()
    return _Z.compress(head + _planes(own) + _planes(sizes) + _planes(step.astype(np.uint32)) + small.tobytes() + large.tobytes())


def _unpack_shard(data: bytes):
    raw = _D.decompress(data)
    n, m, k = np.frombuffer(raw[:24], np.int64).tolist()
    at = 24
    keys = np.cumsum(_unplaned(raw[at : at + 8 * n], np.uint64, n), dtype=np.uint64)
    at += 8 * n
    sizes = _unplaned(raw[at : at + 4 * n], np.uint32, n).astype(np.int64)
    at += 4 * n
    docs = _unplaned(raw[at : at + 4 * m], np.uint32, m).astype(np.int64)
    at += 4 * m
    counts = np.frombuffer(raw[at : at + m], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[at + m : at + m + 4 * k], np.uint32)
    first = np.cumsum(sizes) - sizes
    total = np.cumsum(docs)
    docs = total - np.repeat(total[first] - docs[first], sizes) if n else docs
    return keys, sizes, docs, counts


def _pack_model(t: pa.Table) -> pa.Table:
    """A shard of the model as one blob: number, keys in order, log probabilities."""
    keys = t.column("key").to_numpy().astype(np.uint64)
    o = np.argsort(keys)
    keys, value = keys[o], t.column("logp").to_numpy()[o]
    blob = _Z.compress(np.array([len(keys)], np.int64).tobytes() + _planes(np.diff(keys, prepend=np.uint64(0))) + value.astype(np.float64).tobytes())
    return pa.table({"shard": t.column("shard")[:1], "data": pa.array([blob], pa.binary())})


def _unpack_model(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _D.decompress(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    return np.cumsum(_unplaned(raw[8 : 8 + 8 * n], np.uint64, n), dtype=np.uint64), np.frombuffer(raw[8 + 8 * n :], np.float64)


def partial_sums(docs: DataFrame, logp: DataFrame, shards: int, salts: int, order: int = ORDER) -> DataFrame:
    """(block, shard, sums, rows): of each block of documents, its sums over each shard, and with shard 0 its rows."""
    names = [f.name for f in docs.schema.fields if f.name != "text"]

    def deal(batches):
        part, serial = TaskContext.get().partitionId(), 0
        for b in sliced(batches, 4 * SLICE):
            texts = b.column("text").to_pylist()
            own, i = [], 0
            held = 0
            for j, text in enumerate(texts):
                own.append(counted(keys_of(text, order)))
                held += len(text or "")
                if held >= BLOCK or j == len(texts) - 1:
                    keys = np.concatenate([k for k, _ in own])
                    counts = np.concatenate([c for _, c in own])
                    docs_ = np.repeat(np.arange(len(own), dtype=np.uint32), [len(k) for k, _ in own])
                    o = np.argsort(keys, kind="stable")
                    keys, counts, docs_ = keys[o], counts[o], docs_[o]
                    s = shard_of(keys, shards)
                    o = np.argsort(s.astype(np.uint16) if shards < 65536 else s, kind="stable")
                    edges = np.searchsorted(s[o], np.arange(shards + 1))
                    rows = pa.RecordBatch.from_arrays([*(b.column(x).slice(i, len(own)) for x in names), pa.array([int(c.sum()) for _, c in own], pa.int64())], [*names, "n"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(rows)
                    block = part << 32 | serial
                    salt = int(mix64(np.array([block + 1]))[0] % np.uint64(salts))
                    serial += 1
                    for k in range(shards):
                        x = o[edges[k] : edges[k + 1]]
                        if len(x) or k == 0:  # shard 0 carries the block's documents
                            table_ = sink.getvalue().to_pybytes() if k == 0 else None
                            yield pa.RecordBatch.from_arrays([pa.array([k * salts + salt], pa.int32()), pa.array([block]), pa.array([len(own)], pa.int32()), pa.array([_pack_shard(keys[x], docs_[x], counts[x])], pa.binary()), pa.array([table_], pa.binary())], ["cell", "block", "size", "data", "rows"])
                    own, held, i = [], 0, j + 1

    def score(batches):
        """Of each cell (shard and salt) the shard's copy comes first."""
        cell, known, value = None, None, None
        for b in batches:
            for at, block, size, data, rows in zip(*(b.column(x).to_pylist() for x in ("cell", "block", "size", "data", "rows")), strict=True):
                if size is None:
                    cell, (known, value) = at, _unpack_model(data)
                    continue
                if at != cell:  # a shard without a type
                    cell, known, value = at, np.empty(0, np.uint64), np.empty(0)
                keys, sizes, docs_, counts = _unpack_shard(data)
                p = np.repeat(value[np.searchsorted(known, keys)], sizes) if len(keys) else np.empty(0)
                sums = np.bincount(docs_, counts * p, size).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at // salts], pa.int32()), pa.array([sums], pa.binary()), pa.array([rows], pa.binary())], ["block", "shard", "sums", "rows"])
            tidy()

    dealt = docs.mapInArrow(deal, "cell int, block long, size int, data binary, rows binary")
    model = logp.withColumn("shard", _shard_column(shards)).groupBy("shard").applyInArrow(_pack_model, "shard int, data binary")
    none = lambda kind: F.lit(None).cast(kind)
    copies = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select((F.col("shard") * salts + F.col("salt")).cast("int").alias("cell"), none("long").alias("block"), none("int").alias("size"), "data", none("binary").alias("rows"))
    met = dealt.unionByName(copies).repartitionById(shards * salts, F.col("cell")).sortWithinPartitions(F.col("cell"), F.col("size").asc_nulls_first())
    return met.mapInArrow(score, "block long, shard int, sums binary, rows binary")


def log_likelihoods(docs: DataFrame, logp: DataFrame, shards: int, salts: int, order: int = ORDER) -> DataFrame:
    """docs (text and other columns) with n and logp, the number and summed log probability of the text's n-grams."""

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        total = sum(np.frombuffer(x, np.float64) for x in t.column("sums").to_pylist())
        with pa.ipc.open_stream(t.column("rows")[0].as_py()) as r:
            rows = r.read_all()
        return rows.append_column("logp", pa.array(total))

    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n long, logp double"
    return partial_sums(docs, logp, shards, salts, order).groupBy("block").applyInArrow(gather, schema)


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, fence: float = FENCE) -> DataFrame:
    """doc_id, lang, n_chars (signs), perplexity, threshold, kept for each row of docs (doc_id, lang, text); labels: doc_id, quality."""
    ensure_checkpoint_dir(docs.sparkSession)
    # of the input, before joins blur its size; not of Spark's partitions, as each group is met by a copy of a shard
    groups = max(1, -(-bytes_of(docs) // GROUP))
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted")).distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    docs = docs.join(F.broadcast(trusted) if trusted.count() <= TRUSTED else trusted, F.col("doc_id") == F.col("_trusted"), "left")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    role = F.when(F.col("_trusted").isNull(), 0).otherwise(1 + half.cast("int"))  # 1 trains, 2 sets the threshold
    docs = docs.select("doc_id", "lang", "text", role.alias("role"))
    types = type_counts(docs.select("text", (F.col("role") == 1).alias("trains")), order).checkpoint()
    if types.where("c > 0").isEmpty():
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", F.lit(0).cast("long").alias("n_chars"), none.alias("perplexity"), none.alias("threshold"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("kept"))
    shards = -(-types.count() // TYPES)
    logp = probabilities(types, order).checkpoint()
    scored = log_likelihoods(docs, logp, shards, -(-groups // shards), order).checkpoint()
    scored = scored.withColumn("log_ppl", F.when(F.col("n") > 0, -F.col("logp") / F.col("n")))

    bins = scored.where("role = 2 AND log_ppl IS NOT NULL").select("lang", F.ceil(F.col("log_ppl") / BIN).alias("bin"))
    bins = bins.groupBy("lang", "bin").agg(F.count("*").alias("k"))
    both = bins.select(F.struct("lang").alias("of"), "bin", "k").union(bins.groupBy("bin").agg(F.sum("k").alias("k")).select(F.lit(None).cast("struct<lang:string>").alias("of"), "bin", "k"))
    w = Window.partitionBy("of")
    upto = both.withColumn("upto", F.sum("k").over(w.orderBy("bin"))).withColumn("all", F.sum("k").over(w))
    q = lambda x: F.min(F.when(F.col("upto") >= x * F.col("all"), F.col("bin")))
    fences = upto.groupBy("of").agg(q(0.25).alias("q1"), q(0.75).alias("q3"), F.max("all").alias("all"))
    fences = fences.select("of", "all", ((F.col("q3") + fence * (F.col("q3") - F.col("q1"))) * BIN).alias("fence"))
    own = fences.where(F.col("of").isNotNull() & (F.col("all") >= MIN_TRUSTED)).select(F.col("of.lang").alias("_lang"), F.col("fence").alias("own"))
    every = fences.where("of IS NULL").select(F.col("fence").alias("every")).first()
    limit = F.coalesce("own", F.lit(every[0] if every else None).cast("double")) + SLACK / F.sqrt(F.greatest("n", F.lit(1)))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    kept = F.col("log_ppl").isNotNull() & F.coalesce(F.col("log_ppl") <= limit, F.lit(True))
    return out.select("doc_id", "lang", F.col("n").alias("n_chars"), F.round(F.exp("log_ppl"), 6).alias("perplexity"), F.round(F.exp(limit), 6).alias("threshold"), kept.alias("kept"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    """ORDER is 4: levels of substrings, then probabilities from the shortest up."""
    out = [
        f"""d AS (SELECT row_number() OVER () AS r, doc_id, lang, trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS s,
  CASE WHEN t.id IS NULL THEN 0 ELSE 1 + {crc_sql("doc_id")} % 2 END AS role FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1) t ON t.id = doc_id)""",
        "c AS (SELECT r, role, string_split('   ' || s || ' ', '') AS c FROM d WHERE s <> '')",
        "i AS (SELECT r, role, c, unnest(range(1, len(c) - 2)) AS i FROM c)",
        "g AS (SELECT r, role, c[i] || c[i + 1] || c[i + 2] || c[i + 3] AS g, count(*) AS k FROM i GROUP BY ALL)",
        "t4 AS (SELECT g, coalesce(sum(k) FILTER (WHERE role = 1), 0)::BIGINT AS c FROM g GROUP BY g)",
        "l4 AS (SELECT g, c FROM t4 WHERE c > 0)",
    ]
    for m in (3, 2, 1):
        out.append(f"l{m} AS (SELECT substr(g, 2) AS g, count(*) AS c FROM l{m + 1} GROUP BY 1)")
        out.append(f"t{m} AS (SELECT DISTINCT substr(g, 2) AS g FROM t{m + 1})")
    for m in (1, 2, 3, 4):
        counts = ", ".join(f"count(*) FILTER (WHERE c = {k})::DOUBLE AS n{k}" for k in (1, 2, 3, 4))
        ds = ", ".join(f"CASE WHEN n{k} > 0 THEN least(greatest({k} - {k + 1} * y * n{k + 1} / n{k}, 0.05::DOUBLE), {k}::DOUBLE) ELSE 0.5::DOUBLE * {k} END AS d{k}" for k in (1, 2, 3))
        out.append(f"k{m} AS (SELECT {ds} FROM (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5::DOUBLE END AS y FROM (SELECT {counts} FROM l{m})))")
        out.append(f"e{m} AS (SELECT g, c, c - CASE WHEN c >= 3 THEN d3 WHEN c = 2 THEN d2 ELSE d1 END AS less, CASE WHEN c >= 3 THEN d3 WHEN c = 2 THEN d2 ELSE d1 END AS saved FROM l{m}, k{m})")
        if m == 1:
            out.append("p1 AS (SELECT t1.g, (coalesce(less, 0) + back / (signs + 1)) / total AS p FROM t1 LEFT JOIN e1 USING (g), (SELECT sum(c)::DOUBLE AS total, sum(saved) AS back, count(*) AS signs FROM e1))")
        else:
            out.append(f"s{m} AS (SELECT substr(g, 1, {m - 1}) AS ctx, sum(c)::DOUBLE AS total, sum(saved) AS back FROM e{m} GROUP BY 1)")
            out.append(f"p{m} AS (SELECT t{m}.g, CASE WHEN total IS NULL THEN q.p ELSE (coalesce(less, 0) + back * q.p) / total END AS p FROM t{m} JOIN p{m - 1} q ON q.g = substr(t{m}.g, 2) LEFT JOIN e{m} ON e{m}.g = t{m}.g LEFT JOIN s{m} ON ctx = substr(t{m}.g, 1, {m - 1}))")
    out += [
        "sc AS (SELECT r, sum(k)::BIGINT AS n, -sum(k * ln(p)) / sum(k) AS lp FROM g JOIN p4 USING (g) GROUP BY r)",
        "x AS (SELECT d.r, doc_id, lang, role, coalesce(n, 0) AS n, lp FROM d LEFT JOIN sc USING (r))",
        f"b AS (SELECT coalesce(lang, '') AS la, lang IS NULL AS nl, false AS whole, ceil(lp / {BIN}::DOUBLE)::BIGINT AS bin, count(*) AS k FROM x WHERE role = 2 AND lp IS NOT NULL GROUP BY ALL)",
        "bb AS (SELECT * FROM b UNION ALL SELECT '', false, true, bin, sum(k) FROM b GROUP BY bin)",
        "u AS (SELECT *, sum(k) OVER (PARTITION BY la, nl, whole ORDER BY bin) AS upto, sum(k) OVER (PARTITION BY la, nl, whole) AS n FROM bb)",
        f"f AS (SELECT la, nl, whole, n, (q3 + {FENCE} * (q3 - q1)) * {BIN}::DOUBLE AS fence FROM (SELECT la, nl, whole, max(n) AS n, min(bin) FILTER (WHERE upto >= 0.25 * n) AS q1, min(bin) FILTER (WHERE upto >= 0.75 * n) AS q3 FROM u GROUP BY ALL))",
        f"y AS (SELECT x.*, coalesce(own.fence, every.fence) + {SLACK} / sqrt(greatest(x.n, 1)::DOUBLE) AS edge FROM x LEFT JOIN f own ON NOT own.whole AND own.n >= {MIN_TRUSTED} AND own.la = coalesce(x.lang, '') AND own.nl = (x.lang IS NULL) LEFT JOIN f every ON every.whole)",
    ]
    return f"WITH {', '.join(out)} SELECT doc_id, lang, n AS n_chars, round(exp(lp), 6)::DOUBLE AS perplexity, round(exp(edge), 6)::DOUBLE AS threshold, lp IS NOT NULL AND coalesce(lp <= edge, true) AS kept FROM y"


SQL = _sql()
