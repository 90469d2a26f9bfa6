"""Operator 6: dedup of repeated byte strings by range-partitioned, sorted suffixes.

A byte is removed if a LENGTH-byte string that covers it also starts earlier (in a smaller
doc_id, or in the same document further left).  Strings are judged on the input.

A suffix at every byte would be a hundred times the input, so the suffix array is sparse.  In
each LENGTH-byte window the GRAM-byte string with the least hash (the leftmost of equals) is
its anchor: equal windows have their anchors at the same place in them, and successive
windows mostly share one.  Neighbouring windows with one anchor are a run, whose suffix starts
at the anchor.

1. Splitters, leading bytes of a bounded sample of suffixes, cut the order of suffixes into
   ranges, and every suffix goes to its range with its GRAM leading bytes; those of one hot
   prefix are cut by run and document.  Inputs beyond MAX_PARTS ranges get a second level:
   each range has splitters of its own, and its task goes through its parts one by one.
2. A part is sorted by multikey quicksort over the leading bytes, eight at a time.  Of suffixes
   with equal leading bytes, a run whose whole bytes (by length, place and a keyed 64-bit hash)
   an earlier one of the part has is removed whole.  If one prefix stands before different
   runs, the first of each kind is asked for in step 4.
3. The leading bytes of each part's first and last suffix are compared with those of other
   parts: a prefix that goes on across a boundary is asked for too.
4. The bytes of the runs that were asked for are fetched and dealt by prefix, or, if it is hot,
   by the bytes that LAP neighbouring windows share, after equal windows of a batch were
   merged.  Windows that an earlier run holds are found by hash and compared byte by byte.
   Groups of any size are worked through in blocks.
5. Removed intervals are merged by document and cut out.

Null texts are empty; texts of fewer than LENGTH bytes lose nothing.  Null ids come after all
others.  Rows that repeat doc_id and text are one document, and each get its row; rows that
repeat a doc_id with another text are ordered by a hash of the text.  Other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import secrets
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm.common import NULL_ID, SLICE, bytes_of, mix64, parts_for, shared_path, sliced, table, tidy

LENGTH, GRAM = 100, 40
#: Bytes that are hashed at a time, windows that are compared at a time, text bytes a partition.
CHUNK, WINDOWS, PART = 1 << 18, 1 << 17, 8 << 20
#: Sampled suffixes a splitter, and at most on the driver; one document in SAMPLE is looked at for them.
PER_SPLITTER, SAMPLED, SAMPLE = 64, 1 << 19, 16
#: Ranges of the first level.
MAX_PARTS = 1 << 15
#: Neighbouring windows of a hot prefix that are dealt by the LENGTH - LAP + 1 bytes that they share.
LAP = 16
#: Columns of a suffix's place in the order: its leading words, the run's token, the document.
WORDS = GRAM // 8
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * _ONE
    h += y
    h ^= h >> np.uint64(32)
    h *= _TWO
    h ^= h >> np.uint64(29)
    return h


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8 and of the 32 bytes from each place."""
    h8 = mix64(np.ndarray(len(data) - 7, "<u8", data, 0, (1,)))
    h16 = _join(h8[:-8], h8[8:])
    return h8, _join(h16[:-16], h16[16:])


def _whole(h8, h32, at):
    """Hash of the LENGTH bytes from `at`."""
    return _join(_join(_join(h32[at], h32[at + 32]), h32[at + 64]), h8[at + LENGTH - 8])


def runs(data: bytes, ends: np.ndarray, secret: int = 0):
    """Runs of windows of the concatenated texts that end at `ends`: first window, last window, anchor, token."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
    h8, h32 = _hashes(data)
    gram = _join(h32[: len(data) - GRAM + 1], h8[32 : len(data) - GRAM + 33])
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width = LENGTH - GRAM + 1
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[width - size : width - size + n])
    anchor = (least & low).astype(np.int64)
    valid = np.ones(n, bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - LENGTH + 1) : e] = False
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), n)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    a = anchor[first]
    key = np.uint64(secret)
    token = _join(_join(_whole(h8, h32, first) ^ key, _whole(h8, h32, last) + key), ((last - first) * 256 + a - first).astype(np.uint64))
    return [first, last, a, token]


def leading(data: bytes, at: np.ndarray) -> list[np.ndarray]:
    """The words of GRAM bytes from each place; their order is that of the bytes."""
    wide = np.ndarray(len(data) - 7, ">u8", data, 0, (1,))
    return [wide[at + 8 * k].astype(np.uint64) for k in range(WORDS)]


def prefix_hash(words: list[np.ndarray]) -> np.ndarray:
    h = words[0]
    for w in words[1:]:
        h = _join(mix64(h), w)
    return h


def place(cuts: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """For each row of columns the number of cuts, which are sorted, that are not above it; columns are compared in turn."""
    lo = np.searchsorted(cuts[0], columns[0], "left")
    hi = np.searchsorted(cuts[0], columns[0], "right")
    tied = np.flatnonzero(lo < hi)
    a, b = lo[tied], hi[tied]
    while (a < b).any():
        m = np.minimum((a + b) // 2, len(cuts[0]) - 1)
        below, done = np.ones(len(m), bool), np.zeros(len(m), bool)
        for c, x in zip(cuts[1:], columns[1:], strict=True):
            c, x = c[m], x[tied]
            below = np.where(done, below, c <= x)
            done |= c != x
        more = a < b
        a, b = np.where(more & below, m + 1, a), np.where(more & ~below, m, b)
    lo[tied] = a
    return lo


def multikey_order(*columns: np.ndarray) -> np.ndarray:
    """Multikey quicksort: sort by the first column, and only within equals by the next one."""
    order = np.argsort(columns[0], kind="quicksort")
    part = np.zeros(len(order), np.int64)
    for depth, column in enumerate(columns):
        c = column[order]
        if depth:
            size = np.bincount(part)
            tied = np.flatnonzero(size[part] > 1)
            if not len(tied):
                break
            own = np.lexsort((c[tied], part[tied]))
            order[tied] = order[tied[own]]
            c = column[order]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (c[1:] != c[:-1]) | (part[1:] != part[:-1])
        part = np.cumsum(new) - 1
    return order


def _news(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted list of rows differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


_Z, _D = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(*arrays) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return _Z.compress(np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts))


def _unpacked(data: bytes, *types) -> list:
    raw = _D.decompress(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], np.int64)
    at, out = 8 + 8 * n, []
    for size, t in zip(sizes.tolist(), types, strict=True):
        part = raw[at : at + size]
        out.append(part if t is bytes else np.frombuffer(part, t))
        at += size
    return out


def _suffixes(batch, secret: int):
    """Of a batch with did, th, text: row of each run, its first window, last, anchor (all within the text), token, leading words."""
    texts = batch.column("text").to_pylist()
    found, held, size = [], [], 0

    def work():
        data = b"".join(x[2] for x in held)
        ends = np.cumsum([len(x[2]) for x in held])
        first, last, anchor, token = runs(data, ends, secret)
        at = np.searchsorted(ends, first, "right")
        shift = (np.array([x[1] for x in held]) - np.concatenate([[0], ends[:-1]]))[at]
        found.append([np.array([x[0] for x in held])[at], first + shift, last + shift, anchor + shift, token, *leading(data, anchor)])

    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass") if t else b""
        for c in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
            held.append((i, c, data[c : c + CHUNK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= CHUNK:
                work()
                held, size = [], 0
    if held:
        work()
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the document's place in the order: did, th."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64("text").alias("th"))


def _unsigned(did: np.ndarray) -> np.ndarray:
    """Numbers that are ordered as the ids."""
    return did.astype(np.uint64) ^ np.uint64(1 << 63)


def _sample(keyed: DataFrame, rows: int, secret: int) -> DataFrame:
    """(cut): about `rows` suffixes, chosen by a hash of their places; a cut is the columns of the order as bytes."""
    # text is about twice its Parquet file; other inputs are counted; two runs to each window of anchors
    size = 2 * bytes_of(keyed) or keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    expected = 1 + 2 * size // (LENGTH - GRAM) // SAMPLE
    limit = np.uint64(min(1.0, rows / expected) * (2**64 - 2**12))

    def run(batches):
        for b in sliced(batches, 2 * SLICE):
            s = _suffixes(b, secret)
            if s is None:
                continue
            did = b.column("did").to_numpy()[s[0]]
            take = mix64(prefix_hash(s[5:]) ^ mix64(did.astype(np.uint64) ^ (s[1].astype(np.uint64) << np.uint64(20)))) <= limit
            cut = np.stack([x[take] for x in (*s[5:], s[4], _unsigned(did))], 1).astype(">u8")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in cut], pa.binary())], ["cut"])

    return keyed.where(F.pmod("th", F.lit(SAMPLE)) == 0).select("did", "th", "text").mapInArrow(run, "cut binary")


def _columns(cuts: list[bytes]) -> list[np.ndarray]:
    return list(np.frombuffer(b"".join(cuts), ">u8").reshape(-1, WORDS + 2).T.astype(np.uint64))


def _even(rows: list[bytes], parts: int) -> list[bytes]:
    """At most parts - 1 cuts of sorted rows into equal shares."""
    step = len(rows) / parts
    return sorted({rows[int(step * i)] for i in range(1, parts)}) if len(rows) >= parts else sorted(set(rows))


def splitters(keyed: DataFrame, parts: int, secret: int = 0) -> tuple[list[bytes], set[int]]:
    """At most parts - 1 cuts of the order of suffixes into equal shares, and the hashes of the sample's hot prefixes.

    At most SAMPLED suffixes come to the driver.  A prefix is hot if it has an eighth of a
    partition's share of the sample.
    """
    if parts < 2:
        return [], set()
    rows = sorted(r.cut for r in _sample(keyed, min(SAMPLED, parts * PER_SPLITTER), secret).collect())
    least = max(2, len(rows) / parts / 8)
    hot = [p for p, n in Counter(r[:GRAM] for r in rows).items() if n >= least]
    words = np.frombuffer(b"".join(hot), ">u8").reshape(-1, WORDS).T.astype(np.uint64)
    return _even(rows, parts), set(prefix_hash(list(words)).tolist()) if hot else set()


_SUFFIX = (np.int64, np.int64, np.uint32, np.int64, np.uint8, np.uint8, np.uint64, np.uint64)


def _pack(o, row, did, th, first, last, anchor, token, words) -> bytes:
    """Suffixes o of a batch, in order of their leading bytes, which so compress."""
    rows, own = np.unique(row[o], return_inverse=True)
    keys = np.stack([w[o] for w in words], 1).astype(">u8")
    return _packed(did[rows], th[rows], own.astype(np.uint32), first[o].astype(np.int64), (last[o] - first[o]).astype(np.uint8), (anchor[o] - first[o]).astype(np.uint8), token[o], keys)


def _gathered(blobs: list[bytes]):
    """did, th, first, length, offset, token, words of packed suffixes."""
    got = [_unpacked(x, *_SUFFIX) for x in blobs]
    did = np.concatenate([x[0][x[2]] for x in got])
    th = np.concatenate([x[1][x[2]] for x in got])
    first, length, offset, token = (np.concatenate([x[k] for x in got]) for k in range(3, 7))
    words = [np.concatenate([x[7].reshape(-1, WORDS)[:, k] for x in got]).byteswap() for k in range(WORDS)]
    return did, th, first, length, offset, token, words


def _by_part(batches):
    """(part, list of blobs) of rows that come in order of `part`."""
    part, held = None, []
    for b in batches:
        for p, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(data)
    if held:
        yield part, held


def later_windows(data: bytes, start, first, length, did, th, row, at):
    """Of windows (row of a run, number in the run): their order, and which in it an earlier one equals.

    Windows are brought together by a hash, and then compared with the first byte by byte.
    """
    raw = np.frombuffer(data, np.uint8)
    wide = np.lib.stride_tricks.sliding_window_view(raw, 8)
    places = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    word = lambda where, k: np.ascontiguousarray(wide[where + k]).view(">u8")[:, 0].astype(np.uint64)
    where = start[row] + at
    key = np.zeros(len(row), np.uint64)
    for k in places:
        key = _join(key, mix64(word(where, k)))
    window = first[row] + at
    order = multikey_order(key, _unsigned(did[row]), th[row], window)

    def tell(order, *columns):
        new = _news(*(c[order] for c in columns))
        return np.flatnonzero(new)[np.cumsum(new) - 1], ~new

    head, again = tell(order, key)
    tied = np.flatnonzero(again)
    differ = np.zeros(len(tied), bool)
    for k in places:
        differ |= word(where[order[tied]], k) != word(where[order[head[tied]]], k)
    if differ.any():  # different windows with one hash: sorted by their bytes
        words = [word(where, k) for k in places]
        order = multikey_order(*words, _unsigned(did[row]), th[row], window)
        head, again = tell(order, *words)
    h = order[head]
    same = (did[row[order]] == did[row[h]]) & (th[row[order]] == th[row[h]]) & (window[order] == window[h])
    return order, again & ~same


def _windows_of(length):
    """(row, number) of all windows of runs."""
    n = length.astype(np.int64) + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _span_rows(d, t, window):
    """(did, th, packed intervals) of removed windows."""
    o = np.lexsort((window, t, d))
    d, t, window = d[o], t[o], window[o]
    new = _news(d, t)
    new[1:] |= window[1:] > window[:-1] + 1
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(d)) - 1
    docs_ = np.append(np.flatnonzero(_news(d[lo], t[lo])), len(lo))
    blobs = [_packed(window[lo[i:j]], window[hi[i:j]] + LENGTH) for i, j in zip(docs_[:-1], docs_[1:], strict=True)]
    f = lo[docs_[:-1]]
    return d[f], t[f], blobs


def removed_intervals(keyed: DataFrame, path: str) -> DataFrame:
    """(did, th, spans): packed starts and ends of removed intervals; several rows a document."""
    spark = keyed.sparkSession
    secret = secrets.randbits(64)
    wanted = parts_for(keyed, PART)
    parts = min(wanted, MAX_PARTS)
    subs = -(-wanted // parts)
    cuts, hot = splitters(keyed, parts, secret)
    cut_columns = _columns(cuts)

    def split(columns, at, pick):
        """(number, places in order) of rows pick, dealt by the cuts."""
        own = [c[pick] for c in columns]
        number = place(at, own) if len(at[0]) else np.zeros(len(pick), np.int64)
        order = np.argsort(own[0], kind="quicksort")
        order = order[np.argsort(number[order], kind="stable")]
        edges = np.append(np.flatnonzero(_news(number[order])), len(order))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(number[order[i]]), pick[order[i:j]]

    def deal(batches):
        for b in sliced(batches, 2 * SLICE):
            s = _suffixes(b, secret)
            if s is None:
                continue
            did, th = b.column("did").to_numpy(), b.column("th").to_numpy()
            row, first, last, anchor, token, *words = s
            columns = [*words, token, _unsigned(did[row])]
            ids, blobs = [], []
            for number, o in split(columns, cut_columns, np.arange(len(row))):
                ids.append(number)
                blobs.append(_pack(o, row, did, th, first, last, anchor, token, words))
            for i in range(0, len(ids), 8):  # small batches: Spark holds each whole
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 8], pa.int32()), pa.array(blobs[i : i + 8], pa.binary())], ["pid", "data"])

    def range_of(batches):
        for b in batches:
            rows = b.column("cut").to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(place(cut_columns, _columns(rows)), pa.int32()), b.column("cut")], ["pid", "cut"])

    def inner_cuts(t: pa.Table) -> pa.Table:
        own = _even(sorted(t.column("cut").to_pylist()), subs)
        return pa.table({"pid": t.column("pid")[:1], "data": pa.array([b"".join(own)], pa.binary())})

    def second(batches):
        """Of each range its own cuts come first; its suffixes are dealt by them."""
        at = _columns([])
        for b in batches:
            for pid, first_, data in zip(b.column("pid").to_pylist(), b.column("first").to_pylist(), b.column("data").to_pylist(), strict=True):
                if first_:
                    at = _columns([data])
                    continue
                did, th, first, length, offset, token, words = _gathered([data])
                row = np.arange(len(did))
                ids, blobs = [], []
                for number, o in split([*words, token, _unsigned(did)], at, row):
                    ids.append(pid * subs + number)
                    blobs.append(_pack(o, row, did, th, first, first + length, first + offset, token, words))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["part", "data"])

    def bucket(batches):
        for part, blobs in _by_part(batches):
            yield from one_bucket(part, blobs)
            tidy()

    def one_bucket(part, blobs):
        did, th, first, length, offset, token, words = _gathered(blobs)
        order = multikey_order(*words, token, _unsigned(did), th, first)
        did, th, first, length, offset, token = (x[order] for x in (did, th, first, length, offset, token))
        words = [w[order] for w in words]
        g = _news(*words)
        gt = g | _news(token)
        head = np.flatnonzero(gt)[np.cumsum(gt) - 1]
        later = (did != did[head]) | (th != th[head]) | (first != first[head])
        group = np.cumsum(g) - 1
        kinds = np.bincount(group, gt)[group]
        edge = (group == 0) | (group == group[-1])
        ask = gt & (kinds > 1)
        verge = gt & (kinds == 1) & edge  # asked for if its prefix goes on in another part
        gram = prefix_hash(words)
        out = []

        def emit(pick, key=None):
            pick = pick[np.lexsort((th[pick], did[pick]))]
            at = np.append(np.flatnonzero(_news(did[pick], th[pick])), len(pick))
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                p = pick[i:j]
                x, y = (p[later[p]], p[ask[p]]) if key is None else (p[:0], p)
                spans = _packed(first[x], first[x] + length[x] + LENGTH) if len(x) else None
                asks = _packed(gram[y], first[y], length[y], offset[y]) if len(y) else None
                out.append((did[p[0]], th[p[0]], spans, asks, key, part))

        emit(np.flatnonzero(later | ask))
        for i in {0, len(did) - 1}:
            key = b"".join(int(w[i]).to_bytes(8, "big") for w in words)
            out.append((None, None, None, None, key, part))
            emit(np.flatnonzero(verge & (group == group[i])), key)
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 10_000], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["did", "th", "spans", "asks", "edge", "part"])

    suffixes = keyed.select("did", "th", "text").mapInArrow(deal, "pid int, data binary")
    if subs == 1:
        suffixes = suffixes.repartitionById(parts, F.col("pid")).withColumnRenamed("pid", "part")
    else:
        inner = _sample(keyed, wanted * PER_SPLITTER, secret).mapInArrow(range_of, "pid int, cut binary").groupBy("pid").applyInArrow(inner_cuts, "pid int, data binary")
        suffixes = suffixes.withColumn("first", F.lit(False)).unionByName(inner.withColumn("first", F.lit(True)))
        suffixes = suffixes.repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", F.desc("first")).mapInArrow(second, "part int, data binary").sortWithinPartitions("part")
    suffixes.mapInArrow(bucket, "did long, th long, spans binary, asks binary, edge binary, part int").write.parquet(path)
    sorted_ = spark.read.parquet(path)

    across = sorted_.where("did IS NULL").groupBy("edge").agg(F.countDistinct("part").alias("n")).where("n > 1").select("edge")
    certain = sorted_.where("asks IS NOT NULL AND edge IS NULL").select("did", "th", "asks")
    # a part that is one group is its own first and last: asked for twice is as once
    over = sorted_.where("asks IS NOT NULL AND edge IS NOT NULL").join(across, "edge", "left_semi").select("did", "th", "asks")
    asked = certain.unionByName(over).groupBy(F.col("did").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list("asks").alias("asks"))
    texts = keyed.join(asked, (F.col("did") == F.col("_d")) & (F.col("th") == F.col("_t")))
    total = parts * subs

    def merged_locally(held):
        """Runs of hot prefixes of one batch: removed windows, and what is left of the runs, in laps."""
        gram, did, th, first, length, offset, texts_ = zip(*held, strict=True)
        gram, did, th, first, length, offset = (np.array(x, t) for x, t in zip((gram, did, th, first, length, offset), (np.uint64, *[np.int64] * 5), strict=True))
        data, size = b"".join(texts_), length + LENGTH
        start = np.cumsum(size) - size
        row, at = _windows_of(length)
        order, again = later_windows(data, start, first, length, did, th, row, at)
        gone = order[again]
        left = np.ones(len(row), bool)
        left[gone] = False
        row_, at_ = row[left], at[left]
        lap = (offset[row_] - at_) // LAP
        new = _news(row_, lap)
        new[1:] |= at_[1:] != at_[:-1] + 1
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(row_)) - 1
        found = []
        for r, i, j, k in zip(row_[lo].tolist(), at_[lo].tolist(), at_[hi].tolist(), lap[lo].tolist(), strict=True):
            a = int(start[r] + offset[r]) - k * LAP  # what all windows of the lap share starts here
            pid = xxhash.xxh3_64_intdigest(data[a : a + LENGTH - LAP + 1]) % total
            found.append((pid, (int(gram[r]), int(did[r]), int(th[r]), int(first[r]) + i, j - i, int(offset[r]) - i, data[start[r] + i : start[r] + j + LENGTH])))
        return found, (_span_rows(did[row[gone]], th[row[gone]], (first[row] + at)[gone]) if len(gone) else None)

    _fetched = ["part", "data", "did", "th", "spans"]

    def of_hot(held, keep):
        found, spans = merged_locally(held)
        for pid, run in found:
            keep.setdefault(pid, []).append(run)
        if spans:
            none = [None] * len(spans[2])
            yield pa.RecordBatch.from_arrays([pa.array([int(x) % total for x in spans[0]], pa.int32()), pa.array(none, pa.binary()), pa.array(spans[0]), pa.array(spans[1]), pa.array(spans[2], pa.binary())], _fetched)

    def fetch(batches):
        for b in sliced(batches, 2 * SLICE):
            keep: dict[int, list] = {}
            hottest, windows = [], 0
            for did, th, text, asks in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), b.column("asks").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gram, first, length, offset = (np.concatenate(x) for x in zip(*(_unpacked(a, np.uint64, np.int64, np.uint8, np.uint8) for a in asks), strict=True))
                for g, f, n, o in zip(gram.tolist(), first.tolist(), length.tolist(), offset.tolist(), strict=True):
                    run = (g, did, th, f, n, o, data[f : f + n + LENGTH])
                    if g in hot:
                        hottest.append(run)
                        windows += n + 1
                        if windows > 4 * WINDOWS:
                            yield from of_hot(hottest, keep)
                            hottest, windows = [], 0
                    else:
                        keep.setdefault(g % 1_000_003 % total, []).append(run)
            if hottest:
                yield from of_hot(hottest, keep)
            for pid, rows in keep.items():
                for i in range(0, len(rows), 50_000):
                    g, d, t, f, n, o, s = zip(*rows[i : i + 50_000], strict=True)
                    blob = _packed(np.array(g, np.uint64), np.array(d, np.int64), np.array(t, np.int64), np.array(f, np.int64), np.array(n, np.uint8), np.array(o, np.uint8), b"".join(s))
                    yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([blob], pa.binary()), *(pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.binary()))], _fetched)

    def compare(batches):
        def rest():
            for b in batches:
                own = b.column("data").is_valid()
                done = b.filter(pa.compute.invert(own)).select(["did", "th", "spans"])
                if done.num_rows:
                    out.append(done)
                yield b.filter(own)

        out: list = []
        for _, blobs in _by_part(rest()):
            yield from out
            out.clear()
            yield from one_part(blobs)
            tidy()
        yield from out

    def one_part(blobs):
        got = [_unpacked(x, np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8, bytes) for x in blobs]
        gram, did, th, first, length, offset = (np.concatenate([x[k] for x in got]) for k in range(6))
        data = b"".join(x[6] for x in got)
        del got
        size = length.astype(np.int64) + LENGTH
        start = np.cumsum(size) - size
        order = np.argsort(gram, kind="stable")
        count = length[order].astype(np.int64) + 1
        group = np.append(np.flatnonzero(_news(gram[order])), len(order))
        upto = np.concatenate([[0], np.cumsum(count)])
        i = 0
        while i < len(group) - 1:
            # as many groups as fit a block; a larger one alone, some places from the anchor at a time
            j = max(i + 1, int(np.searchsorted(upto[group], upto[group[i]] + WINDOWS, "right")) - 1)
            r = order[group[i] : group[j]]
            blocks = -(-int(upto[group[j]] - upto[group[i]]) // WINDOWS) if j == i + 1 else 1
            row, at = _windows_of(length[r])
            for block in range(min(blocks, LENGTH)):
                own = slice(None) if blocks == 1 else (offset[r][row].astype(np.int64) - at) % min(blocks, LENGTH) == block
                x, y = row[own], at[own]
                o, again = later_windows(data, start[r], first[r], length[r], did[r], th[r], x, y)
                gone = o[again]
                if len(gone):
                    d, t, spans = _span_rows(did[r][x[gone]], th[r][x[gone]], first[r][x[gone]] + y[gone])
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(spans, pa.binary())], ["did", "th", "spans"])
            i = j

    fetched = texts.select("doc_id", "text", "did", "th", "asks").mapInArrow(fetch, "part int, data binary, did long, th long, spans binary")
    fetched = fetched.repartitionById(parts, F.expr(f"part div {subs}").cast("int"))
    if subs > 1:
        fetched = fetched.sortWithinPartitions("part")
    partial = fetched.mapInArrow(compare, "did long, th long, spans binary")
    return sorted_.where("spans IS NOT NULL").select("did", "th", "spans").unionByName(partial)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals."""
    order = np.argsort(starts)
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    lo = np.flatnonzero(new)
    return list(zip(starts[lo].tolist(), reach[np.append(lo[1:], len(starts)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes that stay."""
    keyed = _keyed(docs)
    path = shared_path(docs.sparkSession, "suffixes")
    spans = removed_intervals(keyed, path).groupBy(F.col("did").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list("spans").alias("spans"))
    joined = keyed.join(spans, (F.col("did") == F.col("_d")) & (F.col("th") == F.col("_t")), "left")

    def cut(batches):
        for b in sliced(batches):
            rows = []
            for text, blobs in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                gone, kept = [], data
                if blobs:
                    gone = merged(*(np.concatenate(x) for x in zip(*(_unpacked(s, np.int64, np.int64) for s in blobs), strict=True)))
                    edges = [0, *(x for g in gone for x in g), len(data)]
                    kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            out = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                out, names = [*out, pa.array(cols[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names)

    return joined.select("doc_id", "text", "did", "th", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every window of every text; the documents' ids differ.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * (250 + {LENGTH - 1})) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - {LENGTH - 1}), 250)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS pos, md5_number(substr(s, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, o, s, unnest(range(0, least(250, length(s) // 2 - {LENGTH - 1}))) AS i FROM c)),
f AS (SELECT k, min(doc_id::HUGEINT * 4294967296 + pos) AS earliest FROM w GROUP BY k HAVING count(*) > 1),
l AS (SELECT doc_id, pos FROM w JOIN f USING (k) WHERE doc_id::HUGEINT * 4294967296 + pos > earliest),
n AS (SELECT doc_id, pos, coalesce((pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {LENGTH})::INT, 1) AS new FROM l),
g AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM n),
sp AS (SELECT doc_id, min(pos) AS a, max(pos) + {LENGTH} AS b FROM g GROUP BY doc_id, g),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM sp UNION ALL SELECT doc_id, max(b), NULL FROM sp GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' ORDER BY x) AS kept FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
