"""Edits as an append-only log: current state is the base with the log folded in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoweave.plans import blocks
from cartoweave.plans.components import ensure_checkpoint_dir

HEIGHTS = ("set_height", "adjust_height")


def _pieces(batches):
    """Edits sorted by cell and number, as one map for each cell of a partition: (cell_id, first, a, b), h -> max(h + a, b), a null where a set made it constant."""
    held = None  # the last cell's map, which the next batch may go on with

    def rows(maps):
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in maps], pa.int64()) for i in range(4)], ["cell_id", "first", "a", "b"])

    for t in batches:
        if not t.num_rows:
            continue
        cell, number, delta = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cell_id", "edit_id", "delta"))
        sets = t.column("sets").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(first, len(cell)))
        # from a cell's last set on: what later edits add, and the highest floor after all that follows it
        last = np.maximum.reduceat(np.where(sets, np.arange(len(cell)), -1), first)
        counts = np.arange(len(cell)) >= np.repeat(last, size)
        total = np.cumsum(np.where(counts & ~sets, delta, 0))
        end = total[first + size - 1]
        floor = np.where(sets, np.maximum(delta, 0), 0)
        low = np.maximum.reduceat(np.where(counts, floor - total, np.iinfo(np.int64).min // 2), first) + end
        start = np.where(first > 0, total[first - 1], 0)
        maps = [(int(c), int(n), None if k >= 0 else int(x), int(y)) for c, n, k, x, y in zip(cell[first], number[first], last, end - start, low, strict=True)]
        if held and held[0] == maps[0][0]:
            maps[0] = _after(held, maps[0])
        elif held:
            maps.insert(0, held)
        held = maps.pop()
        if maps:
            yield rows(maps)
    if held:
        yield rows([held])


def _after(f: tuple, g: tuple) -> tuple:
    """The map that does f, then g."""
    if g[2] is None:
        return (*f[:2], None, g[3])
    return (*f[:2], None if f[2] is None else f[2] + g[2], max(f[3] + g[2], g[3]))


def fold_heights(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """cell_id, height after all set_height (the value) and adjust_height (added, not below 0) edits in order of edit_id.

    An edit is a map h -> max(h + a, b), and so is one edit after another; a set is one that doesn't look at h.
    Edits are dealt by ranges of cell and number, so a cell with very many is cut into pieces; each task makes
    one map of each cell's edits, and a cell's few maps (one a range at most) are applied in order.
    """
    log = edits.where(F.col("op").isin(*HEIGHTS) & F.col("cell_id").isNotNull() & F.col("delta").isNotNull())
    log = log.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("edit_id").cast("long").alias("edit_id"), F.col("delta").cast("long").alias("delta"), (F.col("op") == "set_height").alias("sets"))
    pieces = log.repartitionByRange("cell_id", "edit_id").sortWithinPartitions("cell_id", "edit_id").mapInArrow(_pieces, "cell_id long, first long, a long, b long")
    maps = pieces.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("first", "a", "b"))).alias("maps"))
    folded = F.aggregate("maps", F.col("height").cast("long"), lambda h, m: F.when(m["a"].isNull(), m["b"]).otherwise(F.greatest(h + m["a"], m["b"])))
    return cells.select("cell_id", "height").join(maps, "cell_id", "left").select("cell_id", F.when(F.col("maps").isNull(), F.col("height").cast("long")).otherwise(folded).alias("height"))


#: The number of the mark at the end of a cell's log.
END = (1 << 63) - 1

#: Smooth edits of a block, smooth edits of a block of a small log, and blocks from which a log is no longer small.
SMOOTH, FEWEST, LEAST = 40_000, 500, 16

_LOOK = "block long, id long, cell_id long, own boolean, after long, source long, a double, low double, v double, to long"


def _spans(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start[k] up to start[k + 1] of each k of `which`, and how many each k has."""
    many = start[which + 1] - start[which]
    return np.repeat(start[which] - np.cumsum(many) + many, many) + np.arange(many.sum()), many


def _block(t: pa.Table) -> pa.Table:
    """One block's looks, and where else its smooth edits are looked at (rows with `to`), as a row of kind GRAPH."""
    block = t.column("block")[0].as_py()
    t = t.combine_chunks()
    outs, t = t.filter(pa.compute.is_valid(t.column("to"))), t.filter(pa.compute.is_null(t.column("to")))
    number, own, cell = (t.column(c).to_numpy() for c in ("id", "own", "cell_id"))
    t = t.take(pa.array(np.lexsort((cell, own, number))))
    ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
    known = pa.compute.is_valid(t.column("v")).to_numpy()
    waits = ~known & pa.compute.is_valid(t.column("after")).to_numpy()
    after, source = (t.column(c).fill_null(0).to_numpy() for c in ("after", "source"))
    a, low, v = (t.column(c).fill_null(x).to_numpy() for c, x in (("a", 0.0), ("low", -np.inf), ("v", 0.0)))
    near, far = np.flatnonzero(waits & (source == block)), np.flatnonzero(waits & (source != block))
    at = np.searchsorted(ids, after[near])
    near, far = near[np.argsort(at, kind="stable")], far[np.argsort(after[far], kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ids)))])
    # a smooth edit's looks are side by side, in order of their cells, its own cell's last
    data = blocks.pack(ids=ids, first=np.append(first, len(v)), a=a, low=low, v=v, known=known, near=near, start=start, far=far, far_id=after[far], out=np.searchsorted(ids, outs.column("id").to_numpy()), out_to=outs.column("to").to_numpy())
    return blocks.row(block, data)


def _smoothed(g: dict, state: dict | None, told: np.ndarray, heights: np.ndarray, owners: np.ndarray) -> tuple[dict, tuple]:
    """All smooth edits of a block that can be computed from what is known and what other blocks have told, and those that other blocks look at."""
    n = len(g["ids"])
    v, known, value, done = (state[c] for c in ("v", "known", "value", "done")) if state else (g["v"], g["known"], np.zeros(n), np.zeros(n, bool))
    of = np.repeat(np.arange(n), np.diff(g["first"]))
    open_ = np.bincount(of[~known], minlength=n)
    before = done.copy()

    def tell(looks, height):
        v[looks] = np.maximum(height + g["a"][looks], g["a"][looks] + g["low"][looks])
        known[looks] = True
        np.subtract.at(open_, of[looks], 1)

    told, heights = told[owners >= 0], heights[owners >= 0]
    left, right = (np.searchsorted(g["far_id"], told, side) for side in ("left", "right"))
    many = right - left
    tell(g["far"][np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())], np.repeat(heights, many))
    front = np.flatnonzero((open_ == 0) & ~done)
    while len(front):
        looks, many = _spans(g["first"], front)
        total = np.bincount(np.repeat(np.arange(len(front)), many), v[looks], len(front))
        value[front] = np.clip((v[g["first"][front + 1] - 1] + total / many) / 2, 0.0, 100.0)
        done[front] = True
        places, many = _spans(g["start"], front)
        looks = g["near"][places]
        tell(looks, np.repeat(value[front], many))
        front = np.unique(of[looks])
        front = front[open_[front] == 0]
    out = (done & ~before)[g["out"]]
    seen = g["out"][out]
    return {"ids": g["ids"], "v": v, "known": known, "value": value, "done": done}, (g["out_to"][out], g["ids"][seen], value[seen], np.zeros(len(seen), np.int64))


def _values(batches):
    for b in batches:
        for data in b.column("data"):
            s = blocks.unpack(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(s["ids"][s["done"]]), pa.array(s["value"][s["done"]])], ["after", "value"])


def fold_ordered(cells: DataFrame, edits: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, height (double) after all set_height, adjust_height and smooth edits, each in its place in the order of edit_id.

    A smooth edit moves its cell halfway to the mean of the cell and its neighbours, as they are at that moment, between 0 and 100.
    It marks these cells: between marks and smooth edits a cell's other edits compose to a map h -> max(h + a, b), found by running sums and maxima.
    Then smooth edits are dealt to blocks by ranges of cell and number, so a cell with very many is cut into pieces; a block computes in its task
    all that it can, and tells other blocks what they look at.  So rounds follow how often a chain of smooth edits that touch each other goes from
    block to block, not its length or the log.  Cells that no smooth edit looks at go by fold_heights(), in pieces; a looked-at cell's edits are
    sorted in one task, which spills.  edit_id is unique; edges (src, dst) go both ways, repeats count once, and a cell has few of them.
    """
    spark = cells.sparkSession
    ensure_checkpoint_dir(spark)
    base = cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("height").cast("double").alias("height"))
    log = edits.where(F.col("op").isin(*HEIGHTS, "smooth") & F.col("cell_id").isNotNull() & ((F.col("op") == "smooth") | F.col("delta").isNotNull()))
    log = log.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("edit_id").cast("long").alias("id"), "op", F.col("delta").cast("double").alias("delta")).join(base.select("cell_id"), "cell_id", "left_semi")
    smooth = log.where("op = 'smooth'").select("cell_id", "id")
    if not (n := smooth.count()):
        return fold_heights(cells, edits).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("height").cast("double").alias("height"))
    where = blocks.shared_folder(spark)
    # ranges are sampled: they are dealt once
    dealt = smooth.repartitionByRange(max(1, min(LEAST, n // FEWEST), -(-n // SMOOTH)), "cell_id", "id").select("*", F.spark_partition_id().cast("long").alias("block"))
    dealt.write.parquet(f"{where}/smooth")
    smooth = spark.read.parquet(f"{where}/smooth")
    near = edges.where("src <> dst").select(F.col("src").alias("cell_id"), "dst").distinct()
    looks = smooth.join(near, "cell_id").select("id", F.col("dst").alias("cell_id"), F.lit(False).alias("own"), "block").join(base.select("cell_id"), "cell_id", "left_semi").select("id", "cell_id", "own", "block")
    looks = looks.unionByName(smooth.select("id", "cell_id", F.lit(True).alias("own"), "block"))
    looks.write.parquet(f"{where}/looks")
    looks = spark.read.parquet(f"{where}/looks")
    seen = looks.select("cell_id").distinct().checkpoint()
    none = lambda kind: F.lit(None).cast(kind)
    # a cell's own smooth edit comes after the look that it takes
    rows = log.where("op <> 'smooth'").join(seen, "cell_id", "left_semi").select("cell_id", "id", F.lit(1).alias("turn"), "op", "delta", none("boolean").alias("own"), none("long").alias("block"))
    rows = rows.unionByName(smooth.select("cell_id", "id", F.lit(2).alias("turn"), F.lit("smooth").alias("op"), none("double").alias("delta"), none("boolean").alias("own"), "block"))
    marks = looks.unionByName(seen.select(F.lit(END).alias("id"), "cell_id", F.lit(True).alias("own"), none("long").alias("block")))
    rows = rows.unionByName(marks.select("cell_id", "id", F.lit(0).alias("turn"), F.lit("look").alias("op"), none("double").alias("delta"), "own", "block"))
    so_far = Window.partitionBy("cell_id").orderBy("id", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_smooth = lambda c: F.last(F.when(F.col("op") == "smooth", F.col(c)), ignorenulls=True).over(so_far)
    rows = rows.withColumn("after", of_smooth("id")).withColumn("source", of_smooth("block")).withColumn("sets", F.sum((F.col("op") == "set_height").cast("long")).over(so_far))
    part = Window.partitionBy("cell_id", "after", "sets").orderBy("id", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusts = F.col("op") == "adjust_height"
    rows = rows.withColumn("a", F.sum(F.when(adjusts, F.col("delta")).otherwise(0.0)).over(part)).withColumn("low", F.max(F.when(adjusts, -F.col("a"))).over(part)).withColumn("set", F.max(F.when(F.col("op") == "set_height", F.greatest("delta", F.lit(0.0)))).over(part))
    then = lambda h: F.when(h.isNotNull(), F.greatest(h + F.col("a"), F.col("a") + F.col("low")))
    found = rows.where("op = 'look'").join(base, "cell_id")
    known = F.when(F.col("set").isNotNull(), then(F.col("set"))).when(F.col("after").isNull(), then(F.col("height")))
    found.select("block", "cell_id", "id", "own", F.when(known.isNull(), F.col("after")).alias("after"), "source", "a", "low", known.alias("v")).write.parquet(f"{where}/terms")
    terms = spark.read.parquet(f"{where}/terms")
    ends = terms.where(F.col("id") == END)
    terms = terms.where(F.col("id") != END).withColumn("to", none("long"))
    outs = terms.where("after IS NOT NULL AND source <> block").select(F.col("source").alias("block"), F.col("after").alias("id"), F.col("block").alias("to")).distinct()
    names = [c.split()[0] for c in _LOOK.split(", ")]
    terms.select(*names).unionByName(outs, allowMissingColumns=True).groupBy("block").applyInArrow(_block, blocks.ROW).write.parquet(f"{where}/graph")
    graph = spark.read.schema(blocks.ROW).parquet(f"{where}/graph")
    # every block starts by itself; the owner tells that from what blocks tell each other
    start = graph.select("block", F.lit(0).alias("node"), F.lit(0.0).alias("value"), F.lit(-1).alias("owner"))
    values = blocks.rounds(graph, start, _smoothed, where).select("data").mapInArrow(_values, "after long, value double")
    last = ends.join(values, "after", "left").select("cell_id", F.coalesce("v", then(F.col("value"))).alias("height"))
    rest = fold_heights(cells.join(seen, "cell_id", "left_anti"), edits)
    return rest.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("height").cast("double").alias("height")).unionByName(last)


def latest(edits: DataFrame, key: str = "cell_id") -> DataFrame:
    """The last edit of each key; partial maxima before the shuffle, so a hot key is one row a task."""
    last = edits.groupBy(key).agg(F.max_by(F.struct("edit_id", "ts", "editor", "op", "delta"), "edit_id").alias("e"))
    return last.select(key, "e.*")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the non-null fields of changes (one row a key) put over its own; unknown keys are added."""
    names = [c for c in base.columns if c != key]
    c = changes.select(F.col(key), *[F.col(n).alias(f"_{n}") if n in changes.columns else F.lit(None).alias(f"_{n}") for n in names])
    return base.join(c, key, "full").select(key, *[F.coalesce(f"_{n}", n).alias(n) for n in names])


def remove(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys, key, "left_anti")


def merge_owners(rows: DataFrame, owner: str, into: int, merged: list[int]) -> DataFrame:
    """Rows of the merged owners go to `into`; the union of territories is this relabelling."""
    return rows.withColumn(owner, F.when(F.col(owner).isin(*merged), into).otherwise(F.col(owner)))


def validate(edits: DataFrame, rules: DataFrame) -> DataFrame:
    """edits with `accepted` and `reason`, by rules (op, lowest, highest, most_cells, level) and the editor's level."""
    counts = edits.groupBy("editor", "op").agg(F.count("*").alias("n_cells"))
    e = edits.join(counts, ["editor", "op"]).join(F.broadcast(rules), "op", "left")
    reason = F.when(F.col("lowest").isNull(), "unknown operation").when(~F.col("delta").between(F.col("lowest"), F.col("highest")), "value out of range").when(F.col("n_cells") > F.col("most_cells"), "too many cells").when(F.col("editor") % 4 < F.col("level"), "not permitted")
    return e.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def missing(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Wanted cell_ids that do not exist."""
    return wanted.join(cells.select("cell_id"), "cell_id", "left_anti")


def modify(height: Column, low: int, high: int, add: float = 0, multiply: float = 1, power: float = 1, pivot: int = 0) -> Column:
    """Heights in a range: added to, then multiplied and raised about the pivot; between 0 and 100."""
    h = height.cast("double") + add
    if multiply != 1:
        h = (h - pivot) * multiply + pivot
    if power != 1:
        h = F.pow(F.greatest(h - pivot, F.lit(0.0)), F.lit(power)) + pivot
    return F.when(height.between(low, high), F.greatest(F.lit(0.0), F.least(F.lit(100.0), h))).otherwise(height.cast("double"))


def ordered_path(rows: DataFrame, key: str) -> DataFrame:
    """key and its path, an array of struct<x,y> in order of seq; keys of fewer than two points go."""
    p = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return p.where(F.size("p") >= 2).select(key, F.transform("p", lambda s: F.struct(s["x"], s["y"])).alias("path"))


def steps(rows: DataFrame, key: str = "river_id") -> DataFrame:
    """Each point of a path with the distance and drop to the next one."""
    w = Window.partitionBy(key).orderBy("seq")
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    return rows.withColumn("run", F.sqrt((dx * dx + dy * dy).cast("double"))).withColumn("drop", F.abs(F.lead("height").over(w) - F.col("height")))


def reroute(rows: DataFrame, new: DataFrame, key: str = "river_id") -> DataFrame:
    """Paths with those of the keys in `new` replaced."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stamped(rows: DataFrame) -> DataFrame:
    """rows with updated_at, the time at which they are taken up; one time for all."""
    return rows.withColumn("updated_at", F.current_timestamp())
