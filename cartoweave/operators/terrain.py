"""Heightmap programs on any graph of cells: all blobs and lines of a run of commands grow at once, keyed by their number.

A program is drawn once, on the driver, into at most some dozens of blobs (`drawn`); what grows from them is computed in blocks
of the graph (plans.blocks).  A cell's label for a blob is (hops from its start, height): of the neighbours one hop nearer, the one
that gives most counts.  That order has no cycle, so blocks may settle by themselves and correct each other, and the result is
that of going ring by ring.  A cell behind a ring that has no height left would get none, so a hill's labels go HOPS far, and farther only
while the last ring is alive; lines end with their rings.

Commands that follow each other and grow something are one run: their places are chosen by the heights before the run, and
their amounts are added in their order.  Noise is a hash of blob and cell by whole numbers, so results don't depend on
partitions.  Heights stay within 0 and 100 and are rounded to six places after each command, and floored at the end.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.operators.tiles import nearest_site
from cartoweave.plans import blocks
from cartoweave.sources.generator import Alea

# How fast blobs and lines fall off, by the number of cells that a map is made for; other numbers have the default.
BLOB_POWER = {1000: 0.93, 2000: 0.95, 5000: 0.97, 10000: 0.98, 20000: 0.99, 30000: 0.991, 40000: 0.993, 50000: 0.994, 60000: 0.995, 70000: 0.9955, 80000: 0.996, 90000: 0.9964, 100000: 0.9973}
LINE_POWER = {1000: 0.75, 2000: 0.77, 5000: 0.79, 10000: 0.81, 20000: 0.82, 30000: 0.83, 40000: 0.84, 50000: 0.86, 60000: 0.87, 70000: 0.88, 80000: 0.91, 90000: 0.92, 100000: 0.93}
DEFAULT_BLOB, DEFAULT_LINE = 0.98, 0.81
#: Places that a blob tries, the highest that a hill may make its place, and the lowest place of a pit or trough.
PLACES, TOP, LAND = 50, 90, 20

#: Hops that a blob grows at first; one with height left in its last ring starts again, four times as far.
HOPS = 256

GROWING = ("Hill", "Pit", "Range", "Trough", "Strait")
_STEP = 256  # of labels: hops * _STEP + _STEP - 1 - height


class Blob(NamedTuple):
    """One hill, pit or line: its number, its command's place in the program, and what was drawn for it."""

    b: int
    seq: int
    kind: str
    top: int
    width: int  # of a strait
    seed: int
    x: tuple[float, float]  # where it may start, in hundredths of the map
    y: tuple[float, float]
    tries: int

    @property
    def line(self) -> bool:
        return self.kind in ("Range", "Trough", "Strait")

    def rings(self, power: float) -> list[float]:
        """What a ridge adds to each ring around its path."""
        out, h = [], float(self.top)
        while h >= 2:
            out.append(h)
            h = h**power - 1
        return out

    def reach(self, power: float) -> int:
        """Hops that a line grows; -1 for blobs, which have no bound of their own."""
        return self.width if self.kind == "Strait" else len(self.rings(power)) - 1 if self.line else -1


def drawn(program: list[str], seed: int) -> tuple[list[tuple[str, ...]], list[Blob]]:
    """The commands of a program, split, without inversions that didn't come about, and its blobs, numbered from 0."""
    rng, commands, out = Alea(seed), [], []

    def number(spec: str) -> int:
        low, dash, high = spec[1:].partition("-")
        if dash:
            a, b = int(float(spec[0] + low)), int(float(high))
            return a + int(rng.random() * (b - a + 1))
        return int(float(spec)) + int(rng.random() < float(spec) - int(float(spec)))

    between = lambda spec: (float(spec.split("-")[0]), float(spec.split("-")[-1]))
    for line in program:
        command, *a = line.split()
        if command == "Invert" and rng.random() >= float(a[0]):
            continue
        seq = len(commands)
        commands.append((command, *a))
        mine = lambda: (len(out), seq, command)  # noqa: B023, E731
        salt = lambda: int(rng.random() * 2147480000) + 1
        if command == "Strait":
            if width := number(a[0]):
                out.append(Blob(*mine(), 0, width, salt(), *(((30.0, 70.0), (0.0, 0.0)) if a[1] == "vertical" else ((0.0, 0.0), (30.0, 70.0))), 1))
        elif command in GROWING:
            for _ in range(number(a[0])):
                out.append(Blob(*mine(), min(100, number(a[1])), 0, salt(), between(a[2]), between(a[3]), 1 if command == "Range" else PLACES))
        elif command not in ("Add", "Multiply", "Smooth", "Mask", "Invert"):
            raise ValueError(f"unknown command {command}")
    return commands, out


def runs(commands: list[tuple[str, ...]]) -> list[list[int]]:
    """The commands' places in the program: growing ones that follow each other together, others alone."""
    out: list[list[int]] = []
    for seq, (name, *_) in enumerate(commands):
        if out and name in GROWING and commands[out[-1][-1]][0] in GROWING:
            out[-1].append(seq)
        else:
            out.append([seq])
    return out


def noise(seed, key):
    """A number in [0, 1) of a seed and a key not below 0, both whole, by arithmetic that any engine repeats; arrays or columns."""
    hashed = (key % 2147483648 * 48271 + seed) % 2147483647 * 16807 % 2147483647
    if isinstance(hashed, Column):
        return F.floor(hashed / 7) % 65536 / 65536.0
    return hashed // 7 % 65536 / 65536.0


def _end(b: Blob, box: tuple, px: float, py: float) -> tuple[float, float]:
    """Where a line heads for: a strait to the other side, others to the first of their places that is neither near nor far."""
    x0, x1, y0, y1 = box
    w, h = x1 - x0, y1 - y0
    if b.kind == "Strait":
        f = float(noise(b.seed + 2, 0))
        if b.y == (0.0, 0.0):
            return x0 + w - (px - x0) - 0.1 * w + 0.2 * w * f, y1
        return x1, y0 + h - (py - y0) - 0.1 * h + 0.2 * h * f
    far = w / 3 if b.kind == "Range" else w / 2
    for t in range(PLACES):
        ex, ey = x0 + w * (0.1 + 0.8 * float(noise(b.seed + 2, 2 * t))), y0 + h * (0.15 + 0.7 * float(noise(b.seed + 2, 2 * t + 1)))
        if w / 8 <= abs(ey - py) + abs(ex - px) <= far:
            break
    return ex, ey


def walked(graph: DataFrame, starts: dict[int, tuple], block_of, where: str) -> DataFrame:
    """node, owner: the cells on the way of each walker, greedily to a point; graph has the places of edges' ends as w and cap.

    starts: walker -> (cell, x, y, x of the end, y of the end, seed).  Of the neighbours nearer to the end than the cell, the
    nearest is next, where three in twenty are thought to be nearer by half of the squared distance; ties to the lesser id.  The way ends where none is
    nearer, in a Delaunay graph at the site nearest to the end.  A walker goes on in its task until it leaves the block.
    """
    spark = graph.sparkSession

    def solve(g, state, nodes, values, owners):
        steps, out = list(zip(state["node"], state["owner"], strict=True)) if state else [], []
        for node, far, walker in zip(nodes, values, owners, strict=True):
            *_, ex, ey, seed = starts[int(walker)]
            at = int(np.searchsorted(g["ids"], node))
            while True:
                steps.append((g["ids"][at], walker))
                own, cut = slice(g["start"][at], g["start"][at + 1]), slice(*np.searchsorted(g["cut"], [at, at + 1]))
                ids = np.concatenate([g["ids"][g["dst"][own]], g["cut_dst"][cut]])
                d = (np.concatenate([g["w"][own], g["cut_w"][cut]]) - ex) ** 2 + (np.concatenate([g["cap"][own], g["cut_cap"][cut]]) - ey) ** 2
                nearer = np.flatnonzero(d < far)
                if not len(nearer):
                    break
                judged = d[nearer] * np.where(noise(seed + 1, ids[nearer]) > 0.85, 0.5, 1.0)
                best = nearer[np.lexsort((ids[nearer], judged))[0]]
                far = d[best]
                if best >= own.stop - own.start:
                    out.append((g["cut_to"][cut][best - (own.stop - own.start)], ids[best], far, walker))
                    break
                at = int(g["dst"][own][best])
        steps = np.array(steps, np.int64).reshape(-1, 2)
        return {"node": steps[:, 0], "owner": steps[:, 1]}, [np.array([m[i] for m in out]) for i in range(4)]

    rows = [(cell, (x - ex) ** 2 + (y - ey) ** 2, walker) for walker, (cell, x, y, ex, ey, _) in starts.items()]
    first = spark.createDataFrame(rows, "node long, value double, owner long").withColumn("block", block_of(F.col("node")))

    def ways(batches):
        for batch in batches:
            for data in batch.column("data"):
                s = blocks.unpack(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(s["node"]), pa.array(s["owner"])], ["node", "owner"])

    return blocks.rounds(graph, first, solve, where).select("data").mapInArrow(ways, "node long, owner long")


def grown(graph: DataFrame, start: DataFrame, blobs: list[Blob], order: list[int], block_of, where: str, blob_power: float, line_power: float) -> DataFrame:
    """cell_id, amounts: what each command of a run (`order`, their places in the program) does to a cell that its blobs reach.

    start: node, owner (a place in blobs).  An amount is added, or for a strait the power to which the height is raised.
    """
    seeds, blobby = np.array([b.seed for b in blobs]), np.array([not b.line for b in blobs])
    reach = np.array([b.reach(line_power) if b.line else HOPS for b in blobs])
    tops = np.array([b.top for b in blobs])

    def step(b, label, ids):
        height = _STEP - 1 - label % _STEP
        new = np.where(blobby[b] & (height > 1), np.minimum(_STEP - 1, np.floor(height**blob_power * (0.9 + 0.2 * noise(seeds[b], ids)))), 0)
        return (label // _STEP + 1) * _STEP + _STEP - 1 - new

    def least(at, new):
        best = np.lexsort((new, at))
        return best[np.concatenate([[True], at[best][1:] != at[best][:-1]])] if len(best) else best

    def solve(g, state, nodes, values, owners):
        n = len(g["ids"])
        label = state["label"] if state else np.full(len(blobs) * n, np.inf)
        degree, moved = np.diff(g["start"]), np.zeros(len(label), bool)
        at, new = owners * n + np.searchsorted(g["ids"], nodes), values
        while True:
            keep = least(at, new)
            keep = keep[new[keep] < label[at[keep]]]
            at, new = at[keep], new[keep]
            if not len(at):
                break
            label[at], moved[at] = new, True
            on = new // _STEP < reach[at // n]
            b, node, new = at[on] // n, at[on] % n, new[on]
            many = degree[node]
            edge = np.repeat(g["start"][node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            b, dst = np.repeat(b, many), g["dst"][edge]
            at, new = b * n + dst, step(b, np.repeat(new, many), g["ids"][dst])
        b, cut = np.nonzero(moved.reshape(-1, n)[:, g["cut"]])
        parent = label.reshape(-1, n)[b, g["cut"][cut]]
        on = parent // _STEP < reach[b]
        b, cut, parent = b[on], cut[on], parent[on]
        new = step(b, parent, g["cut_dst"][cut])
        best = np.lexsort((new, g["cut_dst"][cut], b))
        d, o = g["cut_dst"][cut][best], b[best]
        best = best[np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])])] if len(best) else best
        return {"ids": g["ids"], "label": label}, (g["cut_to"][cut][best], g["cut_dst"][cut][best], new[best], b[best])

    def alive(batches):
        for batch in batches:
            for data in batch.column("data"):
                s = blocks.unpack(data.as_py())
                label = s["label"].reshape(-1, len(s["ids"]))
                b, at = np.nonzero(np.isfinite(label) & blobby[:, None])
                on = (label[b, at] // _STEP == reach[b]) & (_STEP - 1 - label[b, at] % _STEP > 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(b[on]), pa.int64())], ["owner"])

    top = F.element_at(F.array(*[F.lit(float(_STEP - 1 - (0 if b.line else b.top))) for b in blobs]), (F.col("owner") + 1).cast("int"))
    first = start.select(block_of(F.col("node")).alias("block"), "node", top.alias("value"), "owner")

    def amounts(batches):
        for batch in batches:
            for data in batch.column("data"):
                s = blocks.unpack(data.as_py())
                n = len(s["ids"])
                label = s["label"].reshape(-1, n)
                out = np.zeros((n, len(order)))
                for i, b in enumerate(blobs):
                    on = np.flatnonzero(np.isfinite(label[i]))
                    hops, k = (label[i][on] // _STEP).astype(int), order.index(b.seq)
                    if b.kind == "Strait":
                        out[on, k] = 0.9 - 0.1 / b.width * (b.width - np.maximum(hops, 1) + 1)
                        continue
                    if b.line:
                        change = np.array(b.rings(line_power))[hops] * (0.85 + 0.3 * noise(b.seed, s["ids"][on])) if tops[i] >= 2 else np.zeros(len(on))
                    else:
                        change = _STEP - 1 - label[i][on] % _STEP
                    out[on, k] += change if b.kind in ("Hill", "Range") else -change
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(order)), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(s["ids"]), flat], ["cell_id", "amounts"])

    for attempt in count():
        found = blocks.rounds(graph, first, solve, f"{where}/{attempt}").select("data")
        farther = [r[0] for r in found.mapInArrow(alive, "owner long").distinct().collect()] if blobby.any() else []  # a few dozens at most
        if not farther:
            return found.mapInArrow(amounts, "cell_id long, amounts array<double>")
        reach = reach.copy()
        reach[farther] *= 4


def _kept(h: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), h)), 6)


def _pointwise(command: tuple[str, ...], box: tuple) -> Column:
    """The height after Add, Multiply or Mask."""
    name, *a = command
    h, v = F.col("h"), float(a[0])
    if name == "Mask":
        x0, x1, y0, y1 = box
        nx, ny = (F.lit(2.0) * (F.col(c).cast("double") - lo) / ((hi - lo) or 1.0) - 1.0 for c, lo, hi in (("x", x0, x1), ("y", y0, y1)))
        edge = (1 - nx * nx) * (1 - ny * ny)
        return _kept((h * (abs(v) - 1) + h * (1 - edge if v < 0 else edge)) / abs(v))
    low, high = (20.0, 100.0) if a[1] == "land" else (0.0, 100.0) if a[1] == "all" else map(float, a[1].split("-"))
    pivot = 20.0 if low == 20.0 else 0.0
    changed = F.greatest(h + v, F.lit(pivot)) if name == "Add" else (h - pivot) * v + pivot
    return _kept(F.when((h >= low) & (h <= high), changed).otherwise(h))


def heights(cells: DataFrame, edges: DataFrame, program: list[str], seed: int, made_for: int | None = None) -> DataFrame:
    """cell_id, height 0..100 (int) of a program over cells (cell_id not below 0, x, y) and edges (src, dst), both ways.

    made_for: the number of cells by which the powers are chosen, by default that of the cells.  No cells, no rows; equal edges count
    once; cells without edges are changed by what starts on them and by commands that need no neighbours; a hill that finds no place is left out.
    """
    spark = cells.sparkSession
    where = blocks.shared_folder(spark)
    cells = cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    box, n = tuple(found)[:4], found[4]
    state = cells.withColumn("h", F.lit(0.0))
    if not n:
        return state.select("cell_id", F.col("h").cast("int").alias("height"))
    blob_power, line_power = BLOB_POWER.get(made_for or n, DEFAULT_BLOB), LINE_POWER.get(made_for or n, DEFAULT_LINE)
    commands, blobs = drawn(program, seed)
    (x0, x1, y0, y1), reach = box, 0.75 * max(1e-9, (max(box[1] - box[0], 1e-9) * max(box[3] - box[2], 1e-9) / n) ** 0.5)
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    # the graph is written once for all runs: edges carry the place of their end, which walkers look at
    ends = edges.join(cells.select(F.col("cell_id").alias("dst"), F.col("x").alias("w"), F.col("y").alias("cap")), "dst")
    block_of = blocks.by_ranges(edges)
    graph = blocks.build(cells.select(F.col("cell_id").alias("node")), ends, block_of, f"{where}/graph")
    if blobs:  # a few dozen rows with up to PLACES places each
        seen = spark.createDataFrame([(b.b, b.kind, b.top, b.seed, *b.x, *b.y, b.tries) for b in blobs], "b long, kind string, top int, seed long, xl double, xh double, yl double, yh double, tries int")
        at = lambda lo, hi, a, z, k: F.lit(a) + F.lit(z - a) * (F.col(lo) + (F.col(hi) - F.col(lo)) * noise(F.col("seed"), F.col("t") * 2 + k)) / 100.0
        seen = seen.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tries").cast("long") - 1))).withColumn("x", at("xl", "xh", x0, x1, 0)).withColumn("y", at("yl", "yh", y0, y1, 1))
        places = nearest_site(seen.withColumn("place", F.col("b") * PLACES + F.col("t")), cells, "place", "cell_id", reach).select("b", "kind", "top", "t", "tries", F.col("x").alias("px"), F.col("y").alias("py"), "cell_id").checkpoint()
    for number, run in enumerate(runs(commands)):
        command = commands[run[0]]
        if command[0] in GROWING:
            mine = [b for b in blobs if b.seq in run]
            fit = F.when(F.col("kind") == "Hill", F.col("h") + F.col("top") <= TOP).when(F.col("kind").isin("Pit", "Trough"), F.col("h") >= LAND).otherwise(True)
            # hills need a fitting place, others take the last
            rank = F.when(fit, F.col("t")).when((F.col("kind") != "Hill") & (F.col("t") == F.col("tries") - 1), F.col("tries"))
            chosen = places.where(F.col("b").isin([b.b for b in mine])).join(state, "cell_id").where(rank.isNotNull()).groupBy("b").agg(F.min(F.struct(rank.alias("r"), "cell_id", "x", "y", "px", "py")).alias("s")).collect() if mine else []  # one row a blob
            starts = {r.b: r.s for r in chosen}
            mine = [b for b in mine if b.b in starts]
            if not mine:
                continue
            start = spark.createDataFrame([(starts[b.b].cell_id, i) for i, b in enumerate(mine)], "node long, owner long")
            lines = {i: (s.cell_id, s.x, s.y, *_end(b, box, s.px, s.py), b.seed) for i, b in enumerate(mine) if b.line for s in [starts[b.b]]}
            if lines:
                start = start.where(~F.col("owner").isin(list(lines))).unionByName(walked(graph, lines, block_of, f"{where}/walk{number}"))
            change = grown(graph, start, mine, run, block_of, f"{where}/grow{number}", blob_power, line_power)
            h = F.col("h")
            for k, seq in enumerate(run):
                amount = F.col("amounts")[k]
                h = _kept(F.when(amount > 0, F.pow(h, amount)).otherwise(h) if commands[seq][0] == "Strait" else h + amount)
            state = state.join(change, "cell_id", "left").select("cell_id", "x", "y", F.when(F.col("amounts").isNull(), F.col("h")).otherwise(h).alias("h")).checkpoint()
        elif command[0] == "Smooth":
            f = float(command[1])
            near = edges.join(state.select(F.col("cell_id").alias("dst"), "h"), "dst").groupBy(F.col("src").alias("cell_id")).agg(F.sum("h").alias("_sum"), F.count("*").alias("_n"))
            mean = (F.col("h") + F.coalesce("_sum", F.lit(0.0))) / (F.coalesce("_n", F.lit(0)) + 1)
            state = state.join(near, "cell_id", "left").select("cell_id", "x", "y", _kept((F.col("h") * (f - 1) + mean) / f).alias("h")).checkpoint()
        elif command[0] == "Invert":
            mirror = [(x0 + x1 - F.col("x") if command[2] != "y" else F.col("x")).alias("x"), (y0 + y1 - F.col("y") if command[2] != "x" else F.col("y")).alias("y")]
            other = nearest_site(cells.select(F.col("cell_id").alias("_key"), *mirror), cells, "_key", "cell_id", reach).select("_key", "cell_id")
            new = other.join(state.select("cell_id", "h"), "cell_id").select(F.col("_key").alias("cell_id"), "h")
            state = cells.join(new, "cell_id").checkpoint()
        else:
            state = state.withColumn("h", _pointwise(command, box))
    return state.select("cell_id", F.floor("h").cast("int").alias("height"))
