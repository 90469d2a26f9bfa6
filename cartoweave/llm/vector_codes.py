"""Operator 13: product codes of vectors, with codebooks trained by filtering Lloyd rounds.

Components become integers, floor(SCALE * x).  Vectors are cut into `parts` equal consecutive
parts; each part position has a codebook of at most `entries` entries, which starts as that part
of the vectors with the least ids.

1. Each task cuts its vectors into blocks.  For each part position of a block a kd-tree is
   built, whose nodes keep their bounding box, the number of their points and the sum of their
   coordinates.  Trees are written once, points in the order of the leaves.
2. A round sends the codebooks (parts times entries, whatever the input) to every task, and goes
   down each tree level by level.  Of a node's candidates, the one nearest to the box's centre
   stays, and so does each one that some corner of the box is nearer to; all others are nearer
   to no point of the box.  A node with one candidate left adds its cached sum and count to it and
   is done; points of other leaves are compared with their leaf's candidates.
3. Sums and counts are added over all tasks; an entry becomes the floored mean of its parts, and
   an unused entry stays.
4. After the last round, parts are assigned once more, by the same filtering.

All arithmetic is on whole numbers.  Of equally near entries the lower index is taken, which the
elimination keeps: an entry with a higher index goes already if it is nowhere nearer.

Dropped are rows whose vector is null, or holds a null, NaN or infinity; so is, as its
squares would not fit 64 bits, one with a component of LIMIT or more in size, and one whose number of
components differs from that of the kept vector with the least id.  If the number of parts doesn't
divide that number, the first parts are one component longer.  Null ids come after all others;
vectors of equal ids are ordered by their components; repeated rows each have a row.  With
fewer vectors than entries there are as many entries as vectors.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import shared_path, sliced, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of a block, points of a leaf, and sizes from which components are not taken.
BLOCK, LEAF, LIMIT = 4096, 8, 1 << 20
#: Labels whose sums are broadcast; more are joined by a shuffle, which adaptive execution splits at a hot label.
BROADCAST_LABELS = 1_000_000
TREES = "ids array<long>, labels array<int>, dims array<int>, points array<binary>, place array<binary>, lo array<binary>, hi array<binary>, sums array<binary>"


def bounds(dim: int, parts: int) -> list[int]:
    """Where the parts start, and where the last ends."""
    return [dim // parts * p + min(p, dim % parts) for p in range(parts + 1)]


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector: rows whose components are all finite and of bearable size, in doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float(LIMIT))))  # NaN is above all numbers
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("vector"))


class Tree:
    """A balanced kd-tree over the rows of one block and part: level k has 2**k nodes, cut at the widest side's median."""

    def __init__(self, points: np.ndarray):
        n, dim = points.shape
        self.levels = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        place = np.arange(n)
        for k in range(self.levels):
            ends = self.ends(n, k)
            node = np.repeat(np.arange(1 << k), np.diff(ends))
            p = points[place]
            lo, hi = (f.reduceat(p, ends[:-1], axis=0) for f in (np.minimum, np.maximum))
            side = (hi - lo).argmax(axis=1) if dim else np.zeros(1 << k, np.int64)
            value = p[np.arange(n), side[node]] if dim else np.zeros(n, np.int64)
            place = place[np.lexsort((value, node))]
        self.place, self.points = place, points[place]
        ends = self.ends(n, self.levels)
        lo, hi, total = (f.reduceat(self.points, ends[:-1], axis=0) for f in (np.minimum, np.maximum, np.add))
        # inner nodes from the leaves up; level k's nodes are rows 2**k - 1 to 2**(k+1) - 2
        los, his, sums = [lo], [hi], [total]
        for _ in range(self.levels):
            los.insert(0, np.minimum(los[0][0::2], los[0][1::2]))
            his.insert(0, np.maximum(his[0][0::2], his[0][1::2]))
            sums.insert(0, sums[0][0::2] + sums[0][1::2])
        self.lo, self.hi, self.sums = (np.concatenate(x) for x in (los, his, sums))

    @staticmethod
    def ends(n: int, level: int) -> np.ndarray:
        """Bounds of a level's nodes among n points in tree order."""
        return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def filtered(points, lo, hi, sums, book, assign: bool):
    """Go down a tree: (sums, counts) by entry, or with assign the entry of each point in tree order."""
    n, dim = points.shape
    k = len(book)
    total, count, code = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(n, np.int64)
    levels = (len(lo) + 1).bit_length() - 2
    norm = (book * book).sum(axis=1)
    alive, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(levels + 1):
        ends = Tree.ends(n, level)
        a, b = lo[(1 << level) - 1 + alive], hi[(1 << level) - 1 + alive]
        # twice the distance to the centre but for a term that all entries share; the first of equals is the lowest index
        far = np.where(may, norm[None] - (a + b) @ book.T, np.iinfo(np.int64).max)
        best = far.argmin(axis=1)
        # least value over the box of |x - z|^2 - |x - z*|^2, which is linear in x
        step = 2 * (book[best][:, None, :] - book[None])
        least = norm[None] - norm[best][:, None] + np.where(step > 0, step * a[:, None, :], step * b[:, None, :]).sum(axis=2)
        out = (least > 0) | ((least == 0) & (np.arange(k)[None] > best[:, None]))
        may &= ~out
        sure = may.sum(axis=1) == 1
        if assign:
            size = np.diff(ends)[alive[sure]]
            at = np.repeat(ends[alive[sure]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            code[at] = np.repeat(best[sure], size)
        else:
            np.add.at(total, best[sure], sums[(1 << level) - 1 + alive[sure]])
            np.add.at(count, best[sure], np.diff(ends)[alive[sure]])
        alive, may = alive[~sure], may[~sure]
        if not len(alive):
            break
        if level < levels:
            alive, may = np.stack([2 * alive, 2 * alive + 1], axis=1).ravel(), np.repeat(may, 2, axis=0)
        else:
            size = np.diff(ends)[alive]
            at = np.repeat(ends[alive] - np.cumsum(size) + size, size) + np.arange(size.sum())
            p = points[at]
            found = np.where(np.repeat(may, size, axis=0), norm[None] - 2 * (p @ book.T), np.iinfo(np.int64).max).argmin(axis=1)
            code[at] = found
            if not assign:
                np.add.at(total, found, p)
                np.add.at(count, found, 1)
    return code if assign else (total, count)


def _ints(rows) -> np.ndarray:
    return np.floor(SCALE * np.asarray(rows, np.float64)).astype(np.int64)


def trees(vectors: DataFrame, dim: int, parts: int = PARTS) -> DataFrame:
    """A row for each block: ids and labels, and for each part position the tree's arrays (columns TREES)."""
    cut = bounds(dim, parts)
    names = [c.split()[0] for c in TREES.split(", ")]

    def block(ids, labels, rows):
        data = _ints(rows)
        grown = [Tree(data[:, cut[p] : cut[p + 1]]) for p in range(parts)]
        packed = [
            [t.points.astype("<i2" if np.abs(t.points).max(initial=0) < 1 << 15 else "<i4").tobytes() for t in grown],
            [t.place.astype("<u2").tobytes() for t in grown],
            *([getattr(t, c).astype(kind).tobytes() for t in grown] for c, kind in (("lo", "<i4"), ("hi", "<i4"), ("sums", "<i8"))),
        ]
        head = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int32())), pa.array([np.diff(cut)], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*head, *(pa.array([x], pa.list_(pa.binary())) for x in packed)], names)

    def run(batches):
        ids, labels, rows = [], [], []
        for b in sliced(batches):
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            rows += list(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim))
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], labels[:BLOCK], rows[:BLOCK])
                ids, labels, rows = ids[BLOCK:], labels[BLOCK:], rows[BLOCK:]
        if ids:
            yield block(ids, labels, rows)

    return vectors.where(F.size("vector") == dim).select("vec_id", "label", "vector").mapInArrow(run, TREES)


def _trees(batches):
    """For each block: its ids, its labels, and an iterator of (points, place, lo, hi, sums) by part."""
    for b in batches:
        for row in range(b.num_rows):
            r = b.slice(row, 1)
            ids, labels = (r.column(c).flatten() for c in ("ids", "labels"))
            nodes = (2 << max(0, int(np.ceil(np.log2(max(1, len(ids) / LEAF)))))) - 1
            raw = [r.column(c)[0].values for c in ("points", "place", "lo", "hi", "sums")]

            def parts(raw=raw, dims=r.column("dims")[0].as_py(), n=len(ids), nodes=nodes):
                for p, dim in enumerate(dims):
                    points, place, lo, hi, sums = (x[p].as_buffer() for x in raw)
                    wide = points.size > 2 * n * dim
                    yield (
                        np.frombuffer(points, "<i4" if wide else "<i2").astype(np.int64).reshape(n, dim),
                        np.frombuffer(place, "<u2").astype(np.int64),
                        *(np.frombuffer(x, kind).astype(np.int64).reshape(nodes, dim) for x, kind in ((lo, "<i4"), (hi, "<i4"), (sums, "<i8"))),
                    )

            yield ids, labels, parts()


def lloyd_round(forest: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: sums and counts of all trees, by part and entry."""

    def run(batches):
        found = [[np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)] for book in books]
        for _, _, parts in _trees(batches):
            for (points, _, *nodes), book, sums in zip(parts, books, found, strict=True):
                total, count = filtered(points, *nodes, book, assign=False)
                sums[0] += total
                sums[1] += count
        for p, (total, count) in enumerate(found):
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p)), pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    width = max(book.shape[1] for book in books)
    added = forest.mapInArrow(run, "part long, entry long, n long, total array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)))
    out = [book.copy() for book in books]
    for r in added.collect():  # parts times entries rows at most
        book = out[r["part"]]
        book[r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(book.shape[1])]
    return out


def assigned(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of all vectors by the given codebooks."""
    digits = 2 * len(books)

    def run(batches):
        for ids, labels, parts in _trees(batches):
            codes, errors = np.empty((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
            for p, ((points, place, *nodes), book) in enumerate(zip(parts, books, strict=True)):
                code = filtered(points, *nodes, book, assign=True)
                codes[place, p] = code
                errors[place] += ((points - book[code]) ** 2).sum(axis=1)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + digits] for i in range(0, len(text), digits)], pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return forest.mapInArrow(run, "vec_id long, label int, code string, error long")


def by_label(rows: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """rows (written, not a plan) with label_error, the sum of error over the rows of the label; nulls are one label."""
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = totals.limit(broadcast_labels + 1).count() <= broadcast_labels
    totals = totals.withColumnRenamed("label", "_label")
    return rows.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: a row for each kept vector; entries is 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    fine = kept(vectors)
    order: list[Column] = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    shape = fine.orderBy(*order).select(F.size("vector").alias("n")).first()
    dim = shape["n"] if shape else 0
    first = [r["vector"] for r in fine.where(F.size("vector") == dim).orderBy(*order).limit(entries).collect()]  # `entries` rows
    data = _ints(first).reshape(len(first), dim)
    cut = bounds(dim, parts)
    books = [data[:, cut[p] : cut[p + 1]] for p in range(parts)]
    if not first:
        return fine.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    path = shared_path(spark, "trees")
    trees(fine, dim, parts).write.option("compression", "zstd").parquet(path)
    forest = spark.read.parquet(path)
    for _ in range(rounds):
        books = lloyd_round(forest, books)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()
    out = shared_path(spark, "codes")
    assigned(forest, books).write.parquet(out)
    return by_label(spark.read.parquet(out), broadcast_labels).withColumn("codebooks_sha256", F.lit(digest))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    ctes = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, vec_id, label, q, v[q * (len(v) // {PARTS}) + 1 : (q + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(q))",
        f"c0 AS MATERIALIZED (SELECT q, r - 1 AS e, x AS z FROM p WHERE r <= {ENTRIES})",
    ]
    near = "SELECT r, vec_id, label, q, x, min([d, e]) AS m FROM (SELECT p.*, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - z[i]) * (x[i] - z[i])))::BIGINT AS d FROM p JOIN c{k} USING (q)) GROUP BY ALL"
    for k in range(ROUNDS):
        ctes += [
            f"a{k} AS MATERIALIZED ({near.format(k=k)})",
            f"s{k} AS (SELECT q, e, list(floor(t::DOUBLE / n)::BIGINT ORDER BY i) AS z FROM (SELECT q, e, i, sum(x[i]) AS t, count(*) AS n FROM (SELECT q, m[2] AS e, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL)",
            f"c{k + 1} AS MATERIALIZED (SELECT q, e, coalesce(s{k}.z, c{k}.z) AS z FROM c{k} LEFT JOIN s{k} USING (q, e))",
        ]
    return f"""
WITH {", ".join(ctes)},
f AS MATERIALIZED ({near.format(k=ROUNDS)}),
o AS (SELECT r, vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY q) AS code, sum(m[1])::BIGINT AS error FROM f GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY q, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM o
"""


SQL = _sql()
