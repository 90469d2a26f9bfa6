"""Block-synchronous computations on graphs: blocks of nodes settle by themselves, and only what crosses a cut is shuffled.

Nodes are dealt to blocks by ranges of their ids, of about EDGES edges each and LEAST blocks at the least (fewer only
for small graphs), so ids should be near where nodes are near, as in rows of a lattice; `block_of` gives any
other rule (squares of a map, say).  A block is one row: its nodes, the edges within it and those that leave it, in arrays.

A round takes the blocks that have messages, with their state, brings each to a local fixpoint in its task, and
writes the new state of these blocks and the messages to others.  States are a log: the last of a block
counts, a round reads only the rounds that wrote its blocks last, and blocks without messages aren't touched.  So the
number of rounds is that of blocks which a path crosses, not of its nodes, and a round costs what its active blocks cost.  Rounds are
written to the shared checkpoint folder, which cuts the lineage.  A node's edges are in one block: for graphs of bounded degree.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.plans.components import connected_components, ensure_checkpoint_dir

#: Edges of a block, edges of a block of a small graph, and blocks from which a graph is no longer small.
EDGES, FEWEST, LEAST = 200_000, 2_500, 16
#: Active blocks that a round's plan names.
NAMED = 1_000

ROW = "block long, kind int, round int, node long, value double, owner long, data binary"
GRAPH, STATE, MESSAGE = 0, 1, 2
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def _table(*columns) -> pa.Table:
    """Rows of ROW from arrays; a scalar stands for itself in every row, None for nulls."""
    n = max(len(c) for c in columns if isinstance(c, (list, np.ndarray)))
    return pa.table([pa.array([c] * n if not isinstance(c, (list, np.ndarray)) else c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def row(block: int, data: bytes) -> pa.Table:
    """A block's row of kind GRAPH."""
    return _table([block], GRAPH, -1, None, None, None, [data])


def shared_folder(spark) -> str:
    """A new folder in the checkpoint folder; it goes with the application."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def by_ranges(edges: DataFrame) -> Callable[[Column], Column]:
    """The block of a node, by equal ranges of ids."""
    seen = edges.agg(F.min("src"), F.max("src"), F.count("*")).first()
    if seen[0] is None:
        return lambda node: F.lit(0).cast("long")
    blocks = max(1, min(LEAST, seen[2] // FEWEST), -(-seen[2] // EDGES))
    width = -(-(seen[1] - seen[0] + 1) // blocks)
    # ids that are no edge's src belong to the first and the last block
    return lambda node: F.greatest(F.lit(0), F.least(F.lit(blocks - 1), F.floor((node - F.lit(seen[0])) / F.lit(width)))).cast("long")


def build(nodes: DataFrame, edges: DataFrame, block_of: Callable[[Column], Column], where: str) -> DataFrame:
    """Rows of kind GRAPH: nodes (node), edges (src, dst, w, cap); a null w is 0, a null cap none.  Edges' ends are nodes, too."""
    inside = [F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("cap")]
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"), F.col("cap").cast("double").alias("cap"))
    rows = rows.unionByName(nodes.select(F.col("node").cast("long").alias("src"), *inside)).unionByName(rows.select(F.col("dst").alias("src"), *inside))
    rows = rows.withColumn("block", block_of(F.col("src"))).withColumn("to", block_of(F.col("dst")))

    def one(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        t = t.combine_chunks()
        ids = np.unique(t.column("src").to_numpy())
        t = t.filter(pa.compute.is_valid(t.column("dst")))
        src, dst, to = (t.column(c).to_numpy() for c in ("src", "dst", "to"))
        w, cap = (t.column(c).fill_null(x).to_numpy() for c, x in (("w", 0.0), ("cap", np.inf)))
        order = np.argsort(src, kind="stable")
        src, dst, to, w, cap = (x[order] for x in (src, dst, to, w, cap))
        own = to == block
        at = np.searchsorted(ids, src)
        start = np.concatenate([[0], np.cumsum(np.bincount(at[own], minlength=len(ids)))])
        data = pack(ids=ids, start=start, dst=np.searchsorted(ids, dst[own]), w=w[own], cap=cap[own], cut=at[~own], cut_dst=dst[~own], cut_to=to[~own], cut_w=w[~own], cut_cap=cap[~own])
        return row(block, data)

    rows.groupBy("block").applyInArrow(one, ROW).write.parquet(where)
    return edges.sparkSession.read.schema(ROW).parquet(where)


def rounds(graph: DataFrame, first: DataFrame, solve, where: str, most: int | None = None) -> DataFrame:
    """The last state (rows of ROW) of each block that got a message.

    first: messages (block, node, value, owner).  solve(graph, state or None, nodes, values, owners) gives
    the new state, a dict of arrays, and messages: arrays of block, node, value and owner.
    """
    spark = graph.sparkSession
    message = [F.lit(MESSAGE).alias("kind"), F.lit(0).alias("round"), "node", "value", "owner", F.lit(None).cast("binary").alias("data")]
    mail = first.select("block", *message).select(*(F.col(n).cast(k) for n, k in (c.split() for c in ROW.split(", "))))
    # the round that wrote a block last, and rounds of more blocks than are named: what they hold is the states that count
    latest, wide = {}, []

    def states(numbers):
        return spark.read.schema(ROW).parquet(*(f"{where}/{n}" for n in sorted({*numbers, *wide}))).where(F.col("kind") == STATE)

    def worker(number: int):
        def one(t: pa.Table) -> pa.Table:
            kind = t.column("kind").to_numpy()
            block = t.column("block")[0].as_py()
            data = t.column("data")
            g = unpack(data[int(np.flatnonzero(kind == GRAPH)[0])].as_py())
            states = np.flatnonzero(kind == STATE)
            state = unpack(data[int(states[t.column("round").to_numpy()[states].argmax()])].as_py()) if len(states) else None
            m = t.filter(pa.array(kind == MESSAGE))
            state, out = solve(g, state, *(m.column(c).to_numpy() for c in ("node", "value", "owner")))
            found = _table([block], STATE, number, None, None, None, [pack(**state)])
            return pa.concat_tables([found, _table(out[0], MESSAGE, number, out[1], out[2], out[3], None)]) if len(out[0]) else found

        return one

    for number in count(1):
        # few blocks are named in the plan, so that the readers skip the others
        active = mail.select("block").distinct()
        named = [r[0] for r in active.limit(NAMED + 1).collect()]
        if number > 1 and not named:
            break
        few = len(named) <= NAMED
        before = {latest[b] for b in named if b in latest} if few else set(latest.values())
        rows = graph.unionByName(states(before)) if before or wide else graph
        rows = rows.where(F.col("block").isin(named)) if few else rows.join(active, "block", "left_semi")
        rows = rows.unionByName(mail)
        rows.groupBy("block").applyInArrow(worker(number), ROW).write.parquet(f"{where}/{number}")
        if few and named:
            latest.update(dict.fromkeys(named, number))
        else:
            wide.append(number)
        done = spark.read.schema(ROW).parquet(f"{where}/{number}")
        mail = done.where(F.col("kind") == MESSAGE)
        if most and number >= most:
            raise RuntimeError(f"not at rest after {most} rounds: is there a cycle?")
    return states(latest.values()).groupBy("block").agg(F.max_by("data", "round").alias("data"))


def _best(where: np.ndarray, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of entries for the same place, the least by value and owner."""
    order = np.lexsort((owner, value, where))
    place = where[order]
    return order[np.concatenate([[True], place[1:] != place[:-1]])] if len(order) else order


def settle(start: DataFrame, edges: DataFrame, how: str = "add", block_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """node, value, owner: the least (value, owner) that reaches each node from start (node, value and, if given, owner).

    edges: src, dst, w and, if given, cap.  A step's value is value + w (how = "add", w not negative) or the greater of both ("max"),
    and a way ends where it exceeds the edge's cap.  Owners, of which the lesser is taken at equal values, are for "add".
    Nodes that nothing reaches have no row.
    """
    spark = start.sparkSession
    if "owner" not in start.columns:
        start = start.withColumn("owner", F.lit(0))
    if "cap" not in edges.columns:
        edges = edges.withColumn("cap", F.lit(None))
    start = start.where("value IS NOT NULL").select(F.col("node").cast("long").alias("node"), F.col("value").cast("double").alias("value"), F.col("owner").cast("long").alias("owner"))
    block_of = block_of or by_ranges(edges)
    where = shared_folder(spark)
    graph = build(start.select("node"), edges, block_of, f"{where}/graph")
    join = np.add if how == "add" else np.maximum

    def solve(g, state, nodes, values, owners):
        n = len(g["ids"])
        value, owner = (state["value"], state["owner"]) if state else (np.full(n, np.inf), np.zeros(n, np.int64))
        at, new, who = np.searchsorted(g["ids"], nodes), values, owners
        degree = np.diff(g["start"])
        moved = np.zeros(n, bool)
        while True:
            better = (new < value[at]) | ((new == value[at]) & (who < owner[at]))
            at, new, who = at[better], new[better], who[better]
            keep = _best(at, new, who)
            front, value[at[keep]], owner[at[keep]] = at[keep], new[keep], who[keep]
            if not len(front):
                break
            moved[front] = True
            many = degree[front]
            edge = np.repeat(g["start"][front] - np.cumsum(many) + many, many) + np.arange(many.sum())
            src = np.repeat(front, many)
            new, at, who = join(value[src], g["w"][edge]), g["dst"][edge], owner[src]
            open_ = new <= g["cap"][edge]
            at, new, who = at[open_], new[open_], who[open_]
        cut = np.flatnonzero(moved[g["cut"]])
        new, who = join(value[g["cut"][cut]], g["cut_w"][cut]), owner[g["cut"][cut]]
        open_ = new <= g["cut_cap"][cut]
        cut, new, who = cut[open_], new[open_], who[open_]
        keep = _best(g["cut_dst"][cut], new, who)
        return {"ids": g["ids"], "value": value, "owner": owner}, (g["cut_to"][cut][keep], g["cut_dst"][cut][keep], new[keep], who[keep])

    last = rounds(graph, start.select(block_of(F.col("node")).alias("block"), "node", "value", "owner"), solve, where)

    def rows(batches):
        for b in batches:
            for data in b.column("data"):
                s = unpack(data.as_py())
                there = np.isfinite(s["value"])
                yield pa.RecordBatch.from_arrays([pa.array(s[c][there]) for c in ("ids", "value", "owner")], ["node", "value", "owner"])

    return last.select("data").mapInArrow(rows, "node long, value double, owner long")


def gathered(flow: DataFrame, block_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node, total): the sum of `amount`, a whole number, over the node and all that drains into it.

    flow: node, to (null or -1 for a sink), amount; a forest.  A block adds up what flows within it and hands on what leaves it.
    """
    spark = flow.sparkSession
    flow = flow.select(F.col("node").cast("long").alias("node"), F.nullif(F.col("to"), F.lit(-1)).cast("long").alias("to"), F.col("amount").cast("long").alias("amount"))
    edges = flow.where("to IS NOT NULL").select(F.col("node").alias("src"), F.col("to").alias("dst"), F.lit(0.0).alias("w"), F.lit(None).alias("cap"))
    block_of = block_of or by_ranges(flow.select(F.col("node").alias("src")))
    where = shared_folder(spark)
    graph = build(flow.select("node"), edges, block_of, f"{where}/graph")

    def solve(g, state, nodes, _, amounts):
        n = len(g["ids"])
        total = state["total"] if state else np.zeros(n, np.int64)
        come = np.zeros(n, np.int64)
        np.add.at(come, np.searchsorted(g["ids"], nodes), amounts)
        # all that comes moves on one step at a time, until it has left or is in a sink
        to = np.full(n, -1)
        degree = np.diff(g["start"])
        to[degree > 0] = g["dst"][g["start"][:-1][degree > 0]]
        passed = come.copy()
        front = np.flatnonzero(come)
        for _ in range(n + 1):
            front = front[to[front] >= 0]
            if not len(front):
                break
            step = np.zeros(n, np.int64)
            np.add.at(step, to[front], come[front])
            come = step
            passed += step
            front = np.flatnonzero(step)
        else:
            raise RuntimeError("the flow has a cycle")
        total = total + passed
        out = passed[g["cut"]]
        some = out != 0
        return {"ids": g["ids"], "total": total}, (g["cut_to"][some], g["cut_dst"][some], np.zeros(some.sum()), out[some])

    # a round for each block that a stream crosses; a stream may come back to a block
    last = rounds(graph, flow.select(block_of(F.col("node")).alias("block"), "node", F.lit(0.0).alias("value"), F.col("amount").alias("owner")), solve, where, most=10_000)

    def rows(batches):
        for b in batches:
            for data in b.column("data"):
                s = unpack(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(s["ids"]), pa.array(s["total"])], ["node", "total"])

    found = last.select("data").mapInArrow(rows, "node long, total long")
    return flow.select("node").join(found, "node", "left").select("node", F.coalesce("total", F.lit(0).cast("long")).alias("total"))


def joined(edges: DataFrame, block_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node, component) for every node that has an edge (src, dst): each block is labelled in its task, and only labels that a cut edge joins go through the rounds of connected_components."""
    spark = edges.sparkSession
    block_of = block_of or by_ranges(edges)
    where = shared_folder(spark)
    given = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.lit(None).alias("w"), F.lit(None).alias("cap"))
    # a link joins both ways, whichever it is given in: cut links are seen from either block
    both = given.unionByName(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "cap"))
    graph = build(given.select(F.col("src").alias("node")), both, block_of, f"{where}/graph")

    def label(batches):
        for b in batches:
            for data in b.column("data"):
                g = unpack(data.as_py())
                n = len(g["ids"])
                src, dst = np.repeat(np.arange(n), np.diff(g["start"])), g["dst"]
                least = np.arange(n)
                while True:  # hooking and pointer jumping
                    new = least.copy()
                    np.minimum.at(new, least[src], least[dst])
                    new = np.minimum(new, new[new])
                    while (new != new[new]).any():
                        new = new[new]
                    if (new == least).all():
                        break
                    least = new
                yield pa.RecordBatch.from_arrays([pa.array(g["ids"]), pa.array(g["ids"][least]), pa.nulls(n, pa.int64())], ["node", "label", "beyond"])
                yield pa.RecordBatch.from_arrays([pa.array(g["ids"][g["cut"]]), pa.array(g["ids"][least][g["cut"]]), pa.array(g["cut_dst"])], ["node", "label", "beyond"])

    graph.select("data").mapInArrow(label, "node long, label long, beyond long").write.parquet(f"{where}/labels")
    found = spark.read.parquet(f"{where}/labels")
    labels = found.where("beyond IS NULL").select("node", "label")
    across = found.where("beyond IS NOT NULL").select("label", "beyond").distinct().join(labels.select(F.col("node").alias("beyond"), F.col("label").alias("other")), "beyond").select(F.col("label").alias("src"), F.col("other").alias("dst")).distinct()
    if found.where("beyond IS NOT NULL").isEmpty():
        return labels.select("node", F.col("label").alias("component"))
    parts = connected_components(across)
    return labels.join(parts.select(F.col("node").alias("label"), "component"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))
