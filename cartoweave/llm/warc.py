"""Operator 9: WARC archives, written and read back by boundary-chain verification.

Writing.  Every page becomes one WARC/1.1 record.  Of records with equal payloads the one with
the largest page_id is a response, the others are revisits that refer to it.  The archives are
plain concatenated records, written by Spark's text writer with the two line ends that close a
record as line separator.

Reading.  Spark's text reader, with a line's end and the magic as separator, cuts an archive at
every place that looks like the start of a record, also inside payloads, and splits large files
among tasks.  Each task emits candidate records with the offset of the record that would
follow (start, header, Content-Length, end mark), and follows these successors within its
split by pointer jumping.  Pointer jumping over the exits of the splits, from each file's
start, then finds the entries of the splits that are reachable, and only candidates on the
chains from these are records; a magic line inside a payload starts no chain.  Payloads stay
in the task that read them: only offsets, header fields and digests are shuffled.  A payload
that holds the magic line and crosses the end of a split is read a second time, and so is one
that starts where OPEN candidates are still open, so false headers cost no more than that.

Payloads are bytes of any encoding; archives may be WARC/1.0 or 1.1, and gzip files (.gz), which
are read whole by one task.

Null html is an empty payload.  Rows with a null page_id are responses and nobody refers to
them.  Rows that repeat a page_id and payload are all responses if the id is the largest.
Null urls are left out of the record, control characters and blanks in urls are escaped.
Other columns are not read.  An empty table gives archives without records and an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoweave.llm.common import shared_path, sliced, table
from cartoweave.plans.components import ensure_checkpoint_dir

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: The magic without the rest of its version; archives are cut where a line begins with it.
START, VERSIONS = b"WARC/1.", (b"0\r\n", b"1\r\n")
#: Candidates of a split that are hashed at a time.
OPEN = 8
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digests that occur twice or more are broadcast up to so many rows (some 100 bytes each), else shuffled.
BROADCAST_ROWS = 100_000


def base32_sha1(data: Column) -> Column:
    """RFC 4648 base32 of SHA-1: 20 bits, five hex digits, are four signs."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archives(pages: DataFrame, path: str) -> None:
    """One record for each row of pages (page_id, url, html)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), base32_sha1(body.cast("binary")).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first")
    ensure_checkpoint_dir(pages.sparkSession)
    firsts = firsts.checkpoint()
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, F.col("digest") == F.col("_d"), "left")
    revisit = F.coalesce(F.col("page_id") < F.col("first"), F.lit(False))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    length = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END),
    )
    rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", END).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.MULTILINE)
_SCAN = "file string, block long, rel long, succ long, exit long, total long, type string, id string, refers string, stated string, length long, digest string, whole boolean"


class _Candidate:
    """A possible record: its header, and the digest of its payload as far as it was read.

    piece: the bytes after START; lazy: what the piece doesn't hold is not read.
    """

    def __init__(self, rel: int, piece: bytes, lazy: bool = False):
        self.rel = rel
        cut = piece.find(b"\r\n\r\n")
        fields = {k.lower(): v for k, v in _FIELD.findall(piece[3:cut].replace(b"\r\n", b"\n"))} if cut >= 0 and piece.startswith(VERSIONS) else {}
        size = fields.get(b"content-length", b"")
        self.valid = size.isdigit() and b"warc-type" in fields
        if not self.valid:
            return
        get = lambda k: fields.get(k, b"").decode("utf-8", "replace")
        self.type, self.id, self.refers = get(b"warc-type"), get(b"warc-record-id"), get(b"warc-refers-to")
        self.stated = get(b"warc-payload-digest").removeprefix("sha1:")
        self.left = int(size)
        self.succ = rel + len(START) + cut + 4 + self.left + 4
        self.sha, self.length = hashlib.sha1(usedforsecurity=False), 0
        block = piece[cut + 4 :]
        if lazy and len(block) < self.left:
            return
        if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
            self.left -= end + 4
            block = block[end + 4 :]
        self.feed(block)

    def feed(self, data: bytes) -> None:
        data = data[: max(self.left, 0)]
        self.left -= len(data)
        self.sha.update(data)
        self.length += len(data)


def _exits(rel: np.ndarray, succ: np.ndarray, total: int) -> np.ndarray:
    """By pointer jumping, the first offset beyond the split that each candidate's chain reaches; -1 for a chain that breaks."""
    n = len(rel)
    at = np.minimum(np.searchsorted(rel, succ), max(n - 1, 0))
    inside = rel[at] == succ if n else np.empty(0, bool)
    last = rel[-1] if n else 0
    jump = np.where(inside, at, np.arange(n))
    while True:
        new = jump[jump]
        if (new == jump).all():
            break
        jump = new
    end = succ[jump]
    return np.where(inside[jump] | (end <= last), -1, end)


def _scan(df: DataFrame, keep_pieces: bool = False) -> DataFrame:
    """Candidates of each split, offsets relative to the first START that the split owns; or all pieces with their bytes."""

    def run(batches):
        from base64 import b32encode

        state: dict = {"key": None}

        def done():
            if state["key"] is None:
                return
            file, block = state["key"]
            c = state["all"]
            rel, succ = np.array([x.rel for x in c], np.int64), np.array([x.succ for x in c], np.int64)
            ends = _exits(rel, succ, state["rel"])
            rows = [(file, block, x.rel, x.succ, int(e), state["rel"], x.type, x.id, x.refers, x.stated, x.length, b32encode(x.sha.digest()).decode(), x.left <= 0) for x, e in zip(c, ends, strict=True)]
            rows.append((file, block, None, None, None, state["rel"], *[None] * 7))  # so that each split is counted
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 20_000], strict=True), types, strict=True)], names)

        names = [x.split()[0] for x in _SCAN.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _SCAN.split(", ")]
        for b in sliced(batches):
            out = []
            for file, block, value in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist(), strict=True):
                data = value + b"\n"  # of the separator that follows, or after the end of a file
                if state["key"] != (file, block):
                    if not keep_pieces:
                        yield from done()
                    state = {"key": (file, block), "rel": 0, "all": [], "open": []}
                    if block:
                        data = START + data
                else:
                    data = START + data
                # the first piece of a file is what stands before the first separator: its first record, if it is an archive
                if keep_pieces:
                    out.append((file, block, state["rel"], data))
                else:
                    for x in state["open"]:
                        x.feed(data)
                    state["open"] = [x for x in state["open"] if x.left > 0]
                    if data.startswith(START):
                        lazy = len(state["open"]) >= OPEN
                        x = _Candidate(state["rel"], data[len(START) :], lazy)
                        if x.valid:
                            state["all"].append(x)
                            if x.left > 0 and not lazy:
                                state["open"].append(x)
                state["rel"] += len(data)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "block", "rel", "data"])
        if not keep_pieces:
            yield from done()

    return df.mapInArrow(run, "file string, block long, rel long, data binary" if keep_pieces else _SCAN)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, off, type, id, refers, stated (digest), length, digest: the records that are reachable from the files' starts."""
    ensure_checkpoint_dir(spark)
    text = spark.read.option("lineSep", "\n" + START.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    scanned = _scan(text).checkpoint()
    # a file's splits in order; each begins where the totals of those before it end
    splits = scanned.where("rel IS NULL").select("file", "block", "total")
    base = splits.select("file", "block", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = scanned.where("rel IS NOT NULL").join(base, ["file", "block"])
    found = found.withColumn("off", F.col("base") + F.col("rel")).withColumn("succ", F.col("base") + F.col("succ")).withColumn("exit", F.when(F.col("exit") >= 0, F.col("base") + F.col("exit")))

    jump = found.select("file", "off", "exit").where("exit IS NOT NULL").checkpoint()
    reached = base.select("file").distinct().withColumn("off", F.lit(0).cast("long")).checkpoint()
    size = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "off"]).select("file", F.col("exit").alias("off"))
        reached = reached.union(ahead).distinct().checkpoint()
        if (now := reached.count()) == size:
            break
        size = now
        there = jump.select("file", F.col("off").alias("exit"), F.col("exit").alias("_next"))
        jump = jump.join(there, ["file", "exit"]).select("file", "off", F.col("_next").alias("exit")).checkpoint()
        if jump.isEmpty():
            # no chain is longer; the ends of the last jumps are in reached already
            break

    marked = found.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left")

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("off")
        off, succ = t.column("off").to_numpy(), t.column("succ").to_numpy()
        on = t.column("entry").fill_null(False).to_numpy(zero_copy_only=False).copy()
        at = np.searchsorted(off, succ)
        for i in range(len(off)):
            if on[i] and at[i] < len(off) and off[at[i]] == succ[i]:
                on[at[i]] = True
        return t.filter(pa.array(on)).select(["file", "off", "succ", "type", "id", "refers", "stated", "length", "digest", "whole"])

    # a group is a split, of bounded size
    records = marked.groupBy("file", "block").applyInArrow(walk, "file string, off long, succ long, type string, id string, refers string, stated string, length long, digest string, whole boolean")
    records = records.checkpoint()
    cut = records.where("NOT whole")
    if not cut.isEmpty():
        parts = _scan(text, keep_pieces=True).join(base, ["file", "block"]).select("file", (F.col("base") + F.col("rel")).alias("start"), "data")
        touched = parts.join(cut.select("file", "off", "succ"), "file").where("start >= off AND start < succ")

        def whole(t: pa.Table) -> pa.Table:
            t = t.sort_by("start")
            data = t.column("data").to_pylist()
            c = _Candidate(0, data[0][len(START) :])
            for d in data[1:]:
                c.feed(d)
            from base64 import b32encode

            return pa.table({"file": t.column("file")[:1], "off": t.column("off")[:1], "length": pa.array([c.length]), "digest": pa.array([b32encode(c.sha.digest()).decode()])})

        again = touched.groupBy("file", "off").applyInArrow(whole, "file string, off long, length long, digest string")
        records = records.where("whole").unionByName(cut.drop("length", "digest").join(again, ["file", "off"]).select(*records.columns))
    return records.drop("succ", "whole")


def archived_pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes the payload's figures from the response."""
    ensure_checkpoint_dir(records.sparkSession)
    rows = records.select(F.expr("try_cast(regexp_extract(id, 'urn:page:(-?[0-9]+)', 1) AS long)").alias("page_id"), "type", F.expr("try_cast(regexp_extract(refers, 'urn:page:(-?[0-9]+)', 1) AS long)").alias("refers_to"), "length", "digest")
    own = rows.where("type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("length").alias("_length")).checkpoint()  # so that adaptive execution can split a response with many revisits
    stated = records.select(F.expr("try_cast(regexp_extract(id, 'urn:page:(-?[0-9]+)', 1) AS long)").alias("page_id"), F.expr("try_cast(regexp_extract(refers, 'urn:page:(-?[0-9]+)', 1) AS long)").alias("refers_to"), "stated", "type")
    full = rows.where("type = 'response'").select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    back = stated.where("type = 'revisit'").join(own, (F.col("refers_to") == F.col("_id")) & (F.col("stated") == F.col("_digest")), "left")
    back = back.select("page_id", F.col("_length").alias("payload_bytes"), F.col("stated").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return full.unionByName(back)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return archived_pages(read_archives(spark, path))


_SIGN = "substr('" + BASE32 + "', 1 + (('0x' || substr(h, {a}, 5))::BIGINT >> {s}) % 32, 1)"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {" || ".join(_SIGN.format(a=1 + 5 * i, s=s) for i in range(8) for s in (15, 10, 5, 0))} AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to FROM m
"""
