"""Operator 5: SimHash near-duplicates by multi-index hashing.

A fingerprint bit is set if over half of a text's word shingles have it set in their hash.
Fingerprints are cut into segments; every fingerprint is put into one table a segment under
the segment's value, and looks into it under all values of a small Hamming ball.  What it
meets there is verified by the complete distance.

Equal fingerprints are merged first, so a group of copies of any size is one entry.  The
tables are dealt by segment value and streamed in sorted order; a bucket's pairs are compared
in bounded blocks inside the task, and only a forest of least distances leaves a block, never
all pairs.  The forests together hold one of all links, so that whatever is connected by
links up to some distance is connected by theirs.  The table of a bucket of more than BUCKET fingerprints is split among
tasks, each of which is shown all rows of the bucket.  Components of these links are found by plans.components.

With s segments, a distance up to d is found for certain if the ball's radius is at least
d // s: op5 uses 64 bits, three segments and radius 1 for d = 4.

keep_one, the pipeline's stage, takes a similarity of at least SIMILARITY of the sets of
five-word shingles.  Its fingerprints are of the distinct shingles, and only texts with equal sets of shingles
(by a 128-bit hash) are merged.  Fingerprints only propose links: each link of the forests is verified by
the two texts' shingles, and verified links make the classes, so every document that goes has
a verified partner in its class.  A pair of similar texts is missed if its fingerprints
differ in more bits than `max_distance`, or in more than the ball in all segments.  What a forest connects
by others, of lesser distance, one of which fails, is compared once more in blocks of sets.

Null and empty texts have no shingle: fingerprint zero, linked like any other.  Rows with a
null doc_id get a fingerprint, no link and a null component.  Repeated rows each get a row.
Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import mix64, sliced, table, tidy
from cartoweave.plans.components import connected_components, ensure_checkpoint_dir

#: Candidate pairs that a task holds at a time, and shingles whose bits it holds.
BLOCK, SHINGLES = 1 << 20, 1 << 15
#: Table rows of a bucket that one task holds; a larger bucket's table is split into blocks.
BUCKET = 50_000
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64, seed 42, of the space-joined shingles of `words` lower-cased words, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate([[0], ends[:-1]])[: len(w) - words + 1].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(h: np.ndarray, bits: int = 64) -> list[int]:
    """bits // 64 unsigned words from the shingles' hashes, the first from the hashes themselves, others from remixed hashes."""
    out = []
    for k in range(bits // 64):
        if not len(h):
            out.append(0)
            continue
        x = h if k == 0 else mix64(h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64))
        ones = np.zeros(64, np.int64)
        for i in range(0, len(x), SHINGLES):
            ones += np.unpackbits(x[i : i + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, distinct: bool = False) -> DataFrame:
    """doc_id, f0, f1, ...: the words of the fingerprint as signed longs.  With distinct, of each shingle once, and s0, s1: a hash of their set."""
    names = [*(f"f{k}" for k in range(bits // 64)), *(("s0", "s1") if distinct else ())]

    def one(text):
        h = shingle_hashes(text, words)
        if not distinct:
            return fingerprint(h, bits)
        h = np.unique(h)
        whole = xxhash.xxh3_128_intdigest(h.tobytes(), SEED)
        return [*fingerprint(h, bits), whole >> 64, whole & (2**64 - 1)]

    def run(batches):
        for b in sliced(batches):
            f = np.array([one(t) for t in b.column("text").to_pylist()], np.uint64).reshape(-1, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(f[:, k]) for k in range(len(names)))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


def _cuts(bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(word, lowest bit, width) of each segment; segments lie within a word."""
    per = segments // (bits // 64) if bits > 64 else segments
    edges = [round(i * 64 / per) for i in range(per + 1)] if bits > 64 else [64 * i // per for i in range(per + 1)]
    return [(w, a, b - a) for w in range(bits // 64) for a, b in zip(edges, edges[1:], strict=False)]


def _forest(u: np.ndarray, v: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the pairs (u > v) that make a forest of least distances; ties by v and u."""
    order = np.lexsort((u, v, far))
    nodes, at = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    rank = np.arange(len(order))
    taken = []
    while True:
        x, y = label[a[rank]], label[b[rank]]
        open_ = x != y
        rank, x, y = rank[open_], x[open_], y[open_]
        if not len(rank):
            break
        # every part takes its first pair; two parts that take the same one hang on the lesser
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, x, rank)
        np.minimum.at(first, y, rank)
        part = np.flatnonzero(first < len(order))
        pick = first[part]
        taken.append(np.unique(pick))
        p, q = label[a[pick]], label[b[pick]]
        to = np.where(p == part, q, p)
        up = np.arange(len(nodes))
        up[part] = to
        both = (up[up[part]] == part) & (part < to)
        up[part[both]] = part[both]
        while True:
            new = up[up]
            if (new == up).all():
                break
            up = new
        label = up[label]
    return order[np.concatenate(taken)] if taken else order[:0]


def links(entries: DataFrame, bits: int, segments: int, ball: int, max_distance: int, group: str | None = None) -> DataFrame:
    """entries: id and f0.. of distinct texts.  (src, dst, far): links that connect all that lie within max_distance of one another.

    With `group`, a column of entries, all pairs of different groups that lie within max_distance.
    """
    n = bits // 64
    names = ["id", *(f"f{k}" for k in range(n)), *([group] if group else [])]
    cuts = _cuts(bits, segments)

    def put(batches):
        for b in batches:
            cols = [b.column(x).to_numpy(zero_copy_only=False) for x in names]
            for s, (word, low, width) in enumerate(cuts):
                value = (cols[1 + word].view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)
                rows = np.arange(len(value))
                keys, whose, probe = [value], [rows], [np.zeros(len(rows), np.int8)]
                for weight in range(1, ball + 1):
                    for places in combinations(range(width), weight):
                        mask = np.uint64(sum(1 << p for p in places))
                        # one of two that differ in one bit has it set and looks under the value without it
                        take = rows[(value & mask) != 0] if ball == 1 else rows
                        keys.append(value[take] ^ mask)
                        whose.append(take)
                        probe.append(np.ones(len(take), np.int8))
                k, i, p = np.concatenate(keys), np.concatenate(whose), np.concatenate(probe)
                # segment, value, and in the lowest bit whether the row only looks
                key = ((k | np.uint64(s << 48)) << np.uint64(1)).astype(np.int64) | p
                for j in range(0, len(key), 50_000):
                    at = i[j : j + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[j : j + 50_000]), *(pa.array(c[at]) for c in cols)], ["key", *names])

    def found(key, probe, cols, old):
        """Links between table rows and the rows of their bucket; the first `old` rows were compared before."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        start = np.repeat(first, size)
        own = np.add.reduceat((probe == 0).astype(np.int64), first)
        meets = np.where(probe == 0, np.arange(len(key)) - start, np.repeat(own, size))
        meets[:old] = 0
        ends = np.cumsum(meets)
        row = 0
        while row < len(key):
            base = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
            m = meets[row:stop]
            total = int(m.sum())
            for lo in range(0, total, BLOCK):  # one row may meet more than a block
                flat = np.arange(lo, min(total, lo + BLOCK))
                e = np.cumsum(m)
                r = np.searchsorted(e, flat, "right")
                a = row + r
                c = start[a] + flat - (e - m)[r]
                far = sum(np.bitwise_count((x[a] ^ x[c]).view(np.uint64)).astype(np.int64) for x in cols[1 : n + 1])
                near = (far <= max_distance) & (cols[0][a] != cols[0][c])
                if group:
                    near &= cols[n + 1][a] != cols[n + 1][c]
                if near.any():
                    x, y, far = cols[0][a[near]], cols[0][c[near]], far[near]
                    u, v = np.maximum(x, y), np.minimum(x, y)
                    keep = slice(None) if group else _forest(u, v, far)
                    yield u[keep], v[keep], far[keep]
            row = stop

    def look(batches):
        """Rows come sorted by bucket, table rows first: of a bucket that goes on, only its table rows are held."""
        held: list[np.ndarray] | None = None
        for b in batches:
            rows = [b.column(x).to_numpy(zero_copy_only=False) for x in ("key", *names)]
            if not len(rows[0]):
                continue
            rows = [rows[0] >> 1, rows[0] & 1, *rows[1:]]
            old = 0 if held is None else len(held[0])
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            for u, v, far in found(rows[0], rows[1], rows[2:], old):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(far.astype(np.int32))], ["src", "dst", "far"])
            keep = (rows[0] == rows[0][-1]) & (rows[1] == 0)
            held = [x[keep] for x in rows]
        tidy()

    values = [F.shiftrightunsigned(f"f{word}", low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(s << 48)) for s, (word, low, width) in enumerate(cuts)]
    sizes = entries.select(F.explode(F.array(*values)).alias("_b")).groupBy("_b").agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET)
    large = sizes.select("_b", F.ceil(F.col("_n") / BUCKET).cast("int").alias("_blocks")).checkpoint()
    dealt = entries.select(*names).mapInArrow(put, "key long, " + ", ".join(f"{c} long" for c in names))
    bucket = F.shiftright("key", 1)
    if not large.isEmpty():
        # each table row of a large bucket is in the table of one block, and looks into all the others
        dealt = dealt.join(large, bucket == F.col("_b"), "left").withColumn("_i", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        looks = ((F.col("key") % 2 == 1) | (F.col("_i") != F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(1))))).cast("long")
        own = F.shiftleft(F.shiftright(F.xxhash64("_b", "_i"), 1), 1)  # a name for bucket and block
        dealt = dealt.select(F.when(F.col("_b").isNull(), F.col("key")).otherwise(own + looks).alias("key"), *names)
    return dealt.repartition(bucket).sortWithinPartitions("key").mapInArrow(look, "src long, dst long, far int")


def _entries(docs: DataFrame, words: int, bits: int, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of docs, and distinct ones (with distinct, distinct sets of shingles) with the smallest doc_id as id."""
    prints = fingerprints(docs, words, bits, distinct).checkpoint()
    return prints, prints.where("doc_id IS NOT NULL").groupBy(*prints.columns[1:]).agg(F.min("doc_id").alias("id")).checkpoint()


def _placed(prints: DataFrame, entries: DataFrame, links_: DataFrame) -> DataFrame:
    names = [c for c in prints.columns if c != "doc_id"]
    parts = connected_components(links_)
    named = entries.join(parts, entries.id == parts.node, "left").select(*names, F.coalesce("component", "id").alias("component_id"))
    placed = prints.join(named, names, "left")
    return placed.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def classes(docs: DataFrame, words: int = 4, bits: int = 64, segments: int = 3, ball: int = 1, max_distance: int = 4) -> DataFrame:
    """doc_id, f0.., component_id (the smallest doc_id reachable over links)."""
    ensure_checkpoint_dir(docs.sparkSession)
    prints, entries = _entries(docs, words, bits)
    return _placed(prints, entries, links(entries, bits, segments, ball, max_distance))


#: Ids that are broadcast, eight bytes each; more are joined by a shuffle of the documents.
BROADCAST_IDS = 1_000_000
#: keep_one's parameters.  Sets with Jaccard similarity 0.8 have cosine 8/9 and differ in
#: arccos(8/9)/pi of the fingerprint's bits, 38.8 of 256 with a spread of 5.7; 56 takes three spreads more.
#: Twenty segments, five a word, with radius 1 find every distance up to 39 for certain, and miss one
#: of 45 bits once in some 5,000 times, one of 56 bits once in 75.
WIDE = {"words": 5, "bits": 256, "segments": 20, "ball": 1, "max_distance": 56}
SIMILARITY = 0.8
#: Shingles of a block of texts that are compared with one another.
SETS = 1 << 20


def _narrow(ids: DataFrame) -> DataFrame:
    """ids, broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, links_: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles (their hashes, ascending) of the linked documents; of a doc_id that several rows have, any row will do."""

    def sets(batches):
        for b in sliced(batches):
            held = [np.unique(shingle_hashes(t, words)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(held, pa.binary())], ["doc_id", "shingles"])

    ids = links_.select(F.col("src").alias("doc_id")).union(links_.select("dst")).distinct().checkpoint()
    return docs.select("doc_id", "text").join(_narrow(ids), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary").checkpoint()


def verified(docs: DataFrame, links_: DataFrame, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """The links (src, dst) whose documents' sets of shingles have at least this Jaccard similarity.

    Of a doc_id that several rows have, any row will do.  Only linked documents are read into sets.
    """
    return _judged(_sets(docs, links_, words), links_, similarity)


def _judged(own: DataFrame, links_: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    def judge(batches):
        for b in sliced(batches):
            ok = []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                # sets of very different size cannot be alike
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst")], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    pairs = links_.join(own.select(F.col("doc_id").alias("src"), F.col("shingles").alias("a")), "src").join(own.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("b")), "dst")
    return pairs.select("src", "dst", "a", "b").mapInArrow(judge, "src long, dst long").distinct()


def _between(own: DataFrame, held: DataFrame) -> DataFrame:
    """Links (src, dst) of at least SIMILARITY between texts of different classes in what proposals held together.

    own: doc_id, shingles; held: node, component, class.  A component's texts are dealt to blocks of some SETS shingles, and each pair of
    blocks is compared in a task, which says only one link of each pair of classes that it joins: what is written
    is a copy of the texts for each block, and not the pairs.
    """

    def compare(t: pa.Table) -> pa.Table:
        ids, kind, side = (t.column(c).to_numpy() for c in ("id", "class", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        order = np.argsort(side, kind="stable")
        size = np.array([len(x) for x in sets])[order]
        flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
        ids, label, side = ids[order], np.unique(kind[order], return_inverse=True)[1], side[order]
        start = np.cumsum(size) - size
        second = int(np.searchsorted(side, 1))  # with one block, all are its own second
        seen = np.zeros(int(flat.max(initial=-1)) + 1, bool)
        out = []
        for x in range(second or len(ids)):
            lo = second or x + 1
            if lo == len(ids) or not size[x] or (label[lo:] == label[x]).all():
                continue
            mine = flat[start[x] : start[x] + size[x]]
            seen[mine] = True
            total = np.concatenate([[0], np.cumsum(seen[flat[start[lo] :]])])
            seen[mine] = False
            at = start[lo:] - start[lo]
            both = total[at + size[lo:]] - total[at]
            for y in lo + np.flatnonzero((both >= SIMILARITY * (size[x] + size[lo:] - both) - 1e-9) & (label[lo:] != label[x])):
                if label[y] != label[x]:
                    out.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
                    label[label == label[y]] = label[x]
        return pa.table([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    rows = held.join(own, held.node == own.doc_id).select("node", "component", "class", "shingles")
    blocks = rows.groupBy("component").agg(F.ceil(F.sum(F.length("shingles")) / (8 * SETS)).cast("int").alias("_n"))
    n, k = F.greatest("_n", F.lit(1)), F.col("_k")
    rows = rows.join(blocks, "component").withColumn("_k", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), n - 1)))
    # alone the blocks are compared by sides that are all 1; of a pair the lesser is side 0
    side = F.when(k == F.col("_j"), 1).when(k < F.col("_j"), 0).otherwise(1)
    rows = rows.select("component", F.least("_k", "_j").alias("a"), F.greatest("_k", "_j").alias("b"), F.col("node").alias("id"), "class", side.alias("side"), "shingles")
    return rows.groupBy("component", "a", "b").applyInArrow(compare, "src long, dst long").distinct()


def near_classes(docs: DataFrame, every: bool = True) -> DataFrame:
    """doc_id, f0.., component_id by verified links of five-word shingles.

    With `every`, all texts that a failed link's forest held together are compared once more, by their sets, across classes, so no pair in
    reach is missed: time grows with the square of such a group, memory and disk by blocks of it.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    prints, entries = _entries(docs, WIDE["words"], WIDE["bits"], distinct=True)
    search = (WIDE["bits"], WIDE["segments"], WIDE["ball"], WIDE["max_distance"])
    proposed = links(entries, *search).select("src", "dst").distinct().checkpoint()
    own = _sets(docs, proposed, WIDE["words"])
    good = _judged(own, proposed).checkpoint()
    failed = proposed.join(good, ["src", "dst"], "left_anti").checkpoint() if every else None
    if every and not failed.isEmpty():
        held = connected_components(proposed).checkpoint()
        open_ = held.join(failed.select(F.col("src").alias("node")), "node", "left_semi").select("component").distinct()
        # two that failed have no third between them
        open_ = held.join(open_, "component", "left_semi").groupBy("component").agg(F.count("*").alias("_n")).where("_n > 2").select("component")
        classes_ = connected_components(good).select("node", F.col("component").alias("class"))
        again = held.join(open_, "component", "left_semi").join(classes_, "node", "left").withColumn("class", F.coalesce("class", "node"))
        good = good.unionByName(_between(own, again)).checkpoint()
    return _placed(prints, entries, good).drop("s0", "s1")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, less the rows whose class holds a smaller doc_id; rows with a null doc_id stay."""
    found = near_classes(docs).where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct().checkpoint()
    return docs.join(_narrow(found), "doc_id", "left_anti").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, 64 bits, links at 4 or fewer differing bits."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
