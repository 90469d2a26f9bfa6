"""Operator 7: reversible line dedup over sharded cuckoo filters and exact reference counts.

A line's key is the line without outer [\\x20\\x09-\\x0D], with A-Z lower-cased; keys of fewer
than MIN_POINTS code points are never touched.  A key that at least two documents hold loses
all its lines but those in the smallest doc_id that holds it.

LineIndex keeps four tables, each a log of changes (a version is only ever added to, so old ones
stay usable): `refs`, a row for each key and document that holds it; `ids`, the documents;
`counts`, by key the number of documents and the smallest; and `filters`, one cuckoo filter a
shard over the keys that are held.  Shards are dealt by the key's hash, counts lie in folders
by shard.

insert() counts the new documents' keys and asks the filters.  A key that they don't know is new:
its count is written as it is, and nothing is looked up.  Others are looked up in `counts`, in
the folders of their shards alone, and added; a filter's false positive costs a lookup.  So a
filter that forgot a key would give that key a wrong count.  Then the new keys go into their
shards' filters; a filter that would be overfull is built anew from its counts.  delete() takes
documents' references out, and keys whose count falls to zero out of the filters: both undo
each other, and both write only what changes.

`deduplicated` inserts its documents in BLOCKS blocks, so that the second block's lookups are
those that the filters ask for.

Reference counts are partial sums before any shuffle, so a line that a third of all documents
hold is one row a task; the join that finds the losing documents is a plain equi-join, which
adaptive execution splits.  Keys are 128-bit hashes (XXH3).

Null and empty texts are one empty line.  Rows that repeat a doc_id are one document for the
counts and each get a row.  Rows with a null doc_id hold no keys and keep all lines.  Other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import BLANKS, ascii_lower, mix64, shared_path, sliced, table
from cartoweave.plans.components import ensure_checkpoint_dir

MIN_POINTS = 10
#: Slots of a filter's bucket, and the share of slots in use for which a filter is sized.
SLOTS, LOAD = 4, 0.8
#: References for which a shard is made, and the share of slots beyond which its filter is built anew.
SHARD_KEYS, FULL = 1 << 18, 0.9
#: Folders of counts; lookups read only those of their shards.
FOLDERS = 256
#: Blocks in which deduplicated() inserts.
BLOCKS = 2


def line_key(line: str) -> str:
    return ascii_lower(line.strip(BLANKS))


def _hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit hashes: 16-bit fingerprints, buckets of four, a power of two of buckets.

    A fingerprint that finds no slot after KICKS moves goes to an exact overflow list, so an
    insertion never fails.
    """

    KICKS = 200

    def __init__(self, slots: np.ndarray, overflow=()):
        self.slots, self.overflow = slots, Counter(overflow)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD) + 1))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        buckets, more = np.frombuffer(data[:16], np.int64)
        end = 16 + int(buckets) * SLOTS * 2
        return cls(np.frombuffer(data[16:end], np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(data[end:], np.uint64).tolist()[: int(more)])

    def dump(self) -> bytes:
        more = np.array([*self.overflow.elements()], np.uint64)
        return np.array([len(self.slots), len(more)], np.int64).tobytes() + self.slots.tobytes() + more.tobytes()

    def _place(self, hashes: np.ndarray):
        h = mix64(hashes.astype(np.uint64))
        f = (h >> np.uint64(48)).astype(np.uint16)
        f[f == 0] = 1
        mask = np.uint64(len(self.slots) - 1)
        a = (h & mask).astype(np.int64)
        return f, a, self._other(a, f)

    def _other(self, bucket, f):
        return bucket ^ (mix64(f.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        f, a, b = self._place(hashes)
        found = (self.slots[a] == f[:, None]).any(1) | (self.slots[b] == f[:, None]).any(1)
        return found | np.isin(hashes.astype(np.uint64), np.array([*self.overflow], np.uint64)) if self.overflow else found

    def full(self, more: int) -> bool:
        """Whether it would be too full with so many more keys."""
        return int((self.slots != 0).sum()) + self.overflow.total() + more > FULL * self.slots.size

    def insert(self, hashes: np.ndarray) -> None:
        """New keys, also those that share a fingerprint with an old one; whole arrays go to free slots at once, the rest by moves."""
        hashes = hashes.astype(np.uint64)
        f, a, b = self._place(hashes)
        left = np.arange(len(f))
        for bucket in (a, b):
            at = left[np.argsort(bucket[left], kind="stable")]
            own = bucket[at]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, int)
            nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            free = self.slots[own] == 0
            rank = np.cumsum(free, 1)
            slot = ((rank == (nth + 1)[:, None]) & free).argmax(1)
            fits = nth < free.sum(1)
            self.slots[own[fits], slot[fits]] = f[at[fits]]
            left = at[~fits]
        for i in left.tolist():
            self._kick(int(a[i]), f[i], int(hashes[i]))

    def _kick(self, bucket: int, f: np.uint16, whole: int) -> None:
        trail = []
        for step in range(self.KICKS):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = f
                return
            s = (bucket + step) % SLOTS
            trail.append((bucket, s))
            f, self.slots[bucket, s] = self.slots[bucket, s], f
            bucket = int(self._other(np.array([bucket]), np.array([f]))[0])
        for bucket, s in reversed(trail):  # undo the moves; the key itself goes to the exact list
            f, self.slots[bucket, s] = self.slots[bucket, s], f
        self.overflow[whole] += 1

    def delete(self, hashes: np.ndarray) -> None:
        """Keys that are in the filter."""
        f, a, b = self._place(hashes.astype(np.uint64))
        for x, i, j, h in zip(f, a.tolist(), b.tolist(), hashes.astype(np.uint64).tolist(), strict=True):
            if self.overflow[h]:
                self.overflow[h] -= 1
                continue
            for bucket in (i, j):
                at = np.flatnonzero(self.slots[bucket] == x)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


def references(docs: DataFrame) -> DataFrame:
    """(h, l, doc_id): one row for each key and row of docs that holds it."""

    def run(batches):
        for b in sliced(batches):
            ids, keys = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t and i is not None:
                    own = {k for k in map(line_key, set(t.split("\n"))) if len(k) >= MIN_POINTS}
                    ids.extend([i] * len(own))
                    keys.extend(map(_hash, own))
            h = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
            for at in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 50_000, 0]), pa.array(h[at : at + 50_000, 1]), pa.array(ids[at : at + 50_000], pa.int64())], ["h", "l", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, l long, doc_id long")


_KEY, _LONG = ["h", "l"], "long"
_SCHEMAS = {
    "refs": "h long, l long, doc_id long, here boolean",
    "ids": "doc_id long, here boolean",
    "counts": "shard int, h long, l long, n_docs long, holder long, new boolean, folder int",
    "filters": "shard int, data binary",
    "log": "place int, version string, removes boolean, shards int",
}


class LineIndex:
    """The state at `path` as of one version; the log says which versions it is made of."""

    def __init__(self, spark: SparkSession, path: str, version: str | None = None):
        self.spark, self.path = spark, path
        #: (version, whether it removes, shards), oldest first
        self.log = [tuple(r)[1:] for r in self._read("log", version).orderBy("place").collect()] if version else []
        self.version = version
        self.shards = self.log[-1][2] if self.log else None
        #: Keys that the last change looked up, and the folders of counts that it read for them.
        self.lookups, self.folders = 0, None

    def _read(self, name: str, version: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}-{version}")

    def _all(self, name: str) -> DataFrame:
        """A table's rows of all versions, with the version's place."""
        parts = [self._read(name, v[0]).withColumn("place", F.lit(i)) for i, v in enumerate(self.log)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _SCHEMAS[name] + ", place int")

    def _current(self, name: str, key: list[str]) -> DataFrame:
        """Rows that are there: of each key the last word, where anything was ever removed."""
        rows = self._all(name)
        if any(v[1] for v in self.log):
            rows = rows.groupBy(*key).agg(F.max_by("here", "place").alias("here"))
        return rows.where("here").select(*key)

    def refs(self) -> DataFrame:
        return self._current("refs", [*_KEY, "doc_id"])

    def ids(self) -> DataFrame:
        return self._current("ids", ["doc_id"])

    def counts(self) -> DataFrame:
        """The exact reference counts: (shard, folder, h, l, n_docs, holder), the last word on each key."""
        rows = self._all("counts")
        if len(self.log) > 1:
            last = F.max_by(F.struct("n_docs", "holder"), "place").alias("c")
            rows = rows.groupBy("shard", "folder", *_KEY).agg(last).select("shard", "folder", *_KEY, "c.*")
        return rows.where("n_docs > 0").select("shard", "folder", *_KEY, "n_docs", "holder")

    def filters(self) -> DataFrame:
        return self._all("filters").where("data IS NOT NULL").groupBy("shard").agg(F.max_by("data", "place").alias("data"))

    def _sharded(self, rows: DataFrame, shards: int) -> DataFrame:
        return rows.withColumn("shard", F.pmod("l", F.lit(shards)).cast("int"))

    def _write(self, rows: DataFrame, name: str, version: str) -> None:
        out = rows.select(*[x.split()[0] for x in _SCHEMAS[name].split(", ")]).write
        (out.partitionBy("folder") if name == "counts" else out).parquet(f"{self.path}/{name}-{version}")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; references that the exact table has already are not added again."""
        ensure_checkpoint_dir(self.spark)
        version = uuid.uuid4().hex
        fresh = references(docs).dropDuplicates([*_KEY, "doc_id"])
        own = docs.select(F.col("doc_id").cast(_LONG).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        if self.log:
            again = own.join(self.ids(), "doc_id", "left_semi").checkpoint()
            if not again.isEmpty():  # documents that are here already, with these or other lines
                old = self.refs().join(again, "doc_id", "left_semi")
                fresh = fresh.join(old, [*_KEY, "doc_id"], "left_anti")
                own = own.join(again, "doc_id", "left_anti")
        here = F.lit(True).alias("here")
        self._write(fresh.select(*_KEY, "doc_id", here), "refs", version)
        self._write(own.select("doc_id", here), "ids", version)
        shards = self.shards or max(1, -(-self._read("refs", version).count() // SHARD_KEYS))
        delta = self._sharded(self._read("refs", version).groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("holder")), shards)
        lookups, folders = 0, None
        if self.log:
            asked = self._asked(delta).checkpoint()
            known = asked.where("known")
            old, folders, lookups = self._looked_up(known)
            old = old.select(*_KEY, F.col("n_docs").alias("_n"), F.col("holder").alias("_first"))
            met = known.join(old, _KEY, "left").select("shard", *_KEY, (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.least("holder", "_first").alias("holder"), F.col("_n").isNull().alias("new"))
            delta = asked.where("NOT known").select("shard", *_KEY, "n_docs", "holder", F.lit(True).alias("new")).unionByName(met)
        else:
            delta = delta.withColumn("new", F.lit(True))
        self._write(delta.withColumn("folder", F.col("shard") % FOLDERS), "counts", version)
        return self._changed(version, False, shards, lookups, folders)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Remove all references of the documents in doc_ids (column doc_id)."""
        ensure_checkpoint_dir(self.spark)
        if not self.log:
            return self
        version = uuid.uuid4().hex
        wanted = doc_ids.select(F.col("doc_id").cast(_LONG).alias("doc_id")).distinct()
        here = F.lit(False).alias("here")
        self._write(self.refs().join(wanted, "doc_id", "left_semi").select(*_KEY, "doc_id", here), "refs", version)
        self._write(self.ids().join(wanted, "doc_id", "left_semi").select("doc_id", here), "ids", version)
        gone = self._read("refs", version)
        lost = self._sharded(gone.groupBy(*_KEY).agg(F.count("*").alias("lost")), self.shards).checkpoint()
        old, folders, lookups = self._looked_up(lost)
        left = lost.join(old.drop("shard"), _KEY).select("shard", "folder", *_KEY, (F.col("n_docs") - F.col("lost")).alias("n_docs"))
        kept = self.refs().join(lost, _KEY, "left_semi").join(gone, [*_KEY, "doc_id"], "left_anti").groupBy(*_KEY).agg(F.min("doc_id").alias("holder"))
        self._write(left.join(kept, _KEY, "left").withColumn("new", F.lit(False)), "counts", version)
        return self._changed(version, True, self.shards, lookups, folders)

    def _looked_up(self, keys: DataFrame) -> tuple[DataFrame, list[int], int]:
        """Counts in the folders of the shards of keys, these folders, and the number of keys."""
        found = keys.groupBy((F.col("shard") % FOLDERS).cast("int").alias("f")).agg(F.count("*").alias("n")).collect()  # FOLDERS rows at most
        folders = sorted(r.f for r in found)
        return self.counts().where(F.col("folder").isin(folders) if folders else F.lit(False)), folders, sum(r.n for r in found)

    def _asked(self, keys: DataFrame) -> DataFrame:
        """keys (shard, h, l, n_docs, holder) with `known`: what the filters say of them."""

        def ask(left, right):
            key, data = left.column("h").to_numpy(), right.column("data").to_pylist()
            known = CuckooFilter.load(data[0]).contains(key) if data and len(key) else np.zeros(len(key), bool)
            return left.append_column("known", pa.array(known))

        rows = keys.select("shard", *_KEY, "n_docs", "holder")
        return rows.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(ask, "shard int, h long, l long, n_docs long, holder long, known boolean")

    def _changed(self, version: str, removes: bool, shards: int, lookups: int, folders) -> LineIndex:
        """Writes the filters of the shards whose keys came or went, and the log."""
        keys = self._read("counts", version).where("n_docs = 0" if removes else "new").select("shard", "h")

        def change(left, right):
            key, data = left.column("h").to_numpy(), right.column("data").to_pylist()
            if not len(key):
                return pa.table({"shard": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
            f = CuckooFilter.load(data[0]) if data else CuckooFilter.sized(2 * len(key))
            if removes:
                f.delete(key)
            elif not f.full(len(key)):
                f.insert(key)
            else:
                f = None  # built anew
            return pa.table({"shard": left.column("shard")[:1], "data": pa.array([f and f.dump()], pa.binary())})

        def build(t):
            f = CuckooFilter.sized(2 * t.num_rows)
            f.insert(t.column("h").to_numpy())
            return pa.table({"shard": t.column("shard")[:1], "data": pa.array([f.dump()], pa.binary())})

        schema = _SCHEMAS["filters"]
        self._write(keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(change, schema), "filters", version)
        new = LineIndex(self.spark, self.path)
        new.log = [*self.log, (version, removes, shards)]
        new.version, new.shards, new.lookups, new.folders = version, shards, lookups, folders
        over = self._read("filters", version).where("data IS NULL").select("shard")
        if not removes and not over.isEmpty():
            again = new.counts().select("shard", "h").join(over, "shard", "left_semi")
            again.groupBy("shard").applyInArrow(build, schema).write.mode("append").parquet(f"{self.path}/filters-{version}")
        self._write(self.spark.createDataFrame([(i, *v) for i, v in enumerate(new.log)], _SCHEMAS["log"]).coalesce(1), "log", version)
        return new

    def decisions(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines the document loses."""
        # cut off here, so that both sides of the join come straight from a shuffle, which adaptive execution can split at a hot key
        ensure_checkpoint_dir(self.spark)
        lost = self.counts().where("n_docs > 1").select(*_KEY, "holder").checkpoint()
        return self.refs().join(lost, _KEY).where("doc_id <> holder").groupBy("doc_id").agg(F.collect_list(F.struct("h", "l")).alias("keys"))


def deduplicated(docs: DataFrame, path: str, blocks: int = BLOCKS) -> LineIndex:
    """The index of docs, inserted block by block; rows of one doc_id are in one block."""
    index = LineIndex(docs.sparkSession, path)
    for k in range(blocks):
        index = index.insert(docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast(_LONG)), F.lit(blocks)) == k))
    return index


def drop_lines(docs: DataFrame, decisions: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, if asked, the kept text and all columns of docs."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")] if with_text else []
    packed = decisions.select(F.col("doc_id").alias("_of"), F.transform("keys", lambda k: F.struct(k["h"], k["l"])).alias("_keys"))
    joined = docs.select("doc_id", "text", *(f"`{f.name}`" for f in others)).join(packed, F.col("doc_id") == F.col("_of"), "left").drop("_of")

    def run(batches):
        for b in sliced(batches):
            n_lines, n_dropped, digests, texts = [], [], [], []
            for t, keys in zip(b.column("text").to_pylist(), b.column("_keys").to_pylist(), strict=True):
                lines = (t or "").split("\n")
                kept = lines
                if keys:
                    gone = {np.array([tuple(k.values())], ">i8").tobytes() for k in keys}
                    kept = [x for x in lines if len(k := line_key(x)) < MIN_POINTS or _hash(k) not in gone]
                text = "\n".join(kept)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                texts.append(text if t is not None else None)
            out = [b.column("doc_id").cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array(texts, pa.string()), *(b.column(f.name) for f in others)], [*names, "text", *(f.name for f in others)]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)
    return joined.mapInArrow(run, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return drop_lines(docs, deduplicated(docs, shared_path(spark, "lines")).decisions())


SQL = r"""
WITH l AS (SELECT r, doc_id, i, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, min(doc_id) AS holder FROM l WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, coalesce(k.holder <> l.doc_id, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
