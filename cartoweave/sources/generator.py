"""Sources that make worlds: point grids, templates, heightmaps.

Grids are generated by spark.range and arithmetic, so they have any size.  Heightmaps follow a
program of commands, one after the other, on one map; many maps run side by side, one task a
map (applyInPandas), each from its own seed.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The named heightmap programs; a line is command, count, height, x range, y range.
TEMPLATES = {
    "default": [
        "Hill 1 90-100 44-56 40-60",
        "Multiply 0.8 50-100 0 0",
        "Range 1.5 30-55 45-55 40-60",
        "Smooth 3 0 0 0",
        "Hill 1.5 35-45 25-30 20-75",
        "Hill 1 35-55 75-80 25-75",
        "Hill 0.5 20-25 10-15 20-25",
        "Mask 3 0 0 0",
    ],
    "highVolcano": [
        "Hill 1 90-100 50-55 40-45",
        "Hill 1.5 45-65 40-50 35-55",
        "Hill 1 45-65 75-80 25-75",
    ],
    "volcano": [
        "Hill 1 90-100 44-56 40-60",
        "Multiply 0.8 50-100 0 0",
        "Range 1.5 30-55 45-55 40-60",
        "Smooth 3 0 0 0",
        "Hill 1.5 35-45 25-30 20-75",
        "Hill 1 35-55 75-80 25-75",
        "Hill 0.5 20-25 10-15 20-25",
        "Mask 3 0 0 0",
    ],
    "highIsland": [
        "Hill 1 90-100 65-75 47-53",
        "Add 7 all 0 0",
        "Hill 5-6 20-30 25-55 45-55",
        "Range 1 40-50 45-55 45-55",
        "Multiply 0.8 land 0 0",
        "Mask 3 0 0 0",
        "Smooth 2 0 0 0",
        "Trough 2-3 20-30 20-30 20-30",
        "Trough 2-3 20-30 60-80 70-80",
        "Hill 1 10-15 60-60 50-50",
        "Hill 1.5 13-16 15-20 20-75",
        "Range 1.5 30-40 15-85 30-40",
        "Range 1.5 30-40 15-85 60-70",
        "Pit 3-5 10-30 15-85 20-80",
    ],
    "lowIsland": [
        "Hill 1 90-99 60-80 45-55",
        "Hill 1-2 20-30 10-30 10-90",
        "Smooth 2 0 0 0",
        "Hill 6-7 25-35 20-70 30-70",
        "Range 1 40-50 45-55 45-55",
        "Trough 2-3 20-30 15-85 20-30",
        "Trough 2-3 20-30 15-85 70-80",
        "Hill 1.5 10-15 5-15 20-80",
        "Hill 1 10-15 85-95 70-80",
        "Pit 5-7 15-25 15-85 20-80",
        "Multiply 0.4 20-100 0 0",
        "Mask 4 0 0 0",
    ],
    "continents": [
        "Hill 1 80-85 60-80 40-60",
        "Hill 1 80-85 20-30 40-60",
        "Hill 6-7 15-30 25-75 15-85",
        "Multiply 0.6 land 0 0",
        "Hill 8-10 5-10 15-85 20-80",
        "Range 1-2 30-60 5-15 25-75",
        "Range 1-2 30-60 80-95 25-75",
        "Range 0-3 30-60 80-90 20-80",
        "Strait 2 vertical 0 0",
        "Strait 1 vertical 0 0",
        "Smooth 3 0 0 0",
        "Trough 3-4 15-20 15-85 20-80",
        "Trough 3-4 5-10 45-55 45-55",
        "Pit 3-4 10-20 15-85 20-80",
        "Mask 4 0 0 0",
    ],
    "archipelago": [
        "Add 11 all 0 0",
        "Range 2-3 40-60 20-80 20-80",
        "Hill 5 15-20 10-90 30-70",
        "Hill 2 10-15 10-30 20-80",
        "Hill 2 10-15 60-90 20-80",
        "Smooth 3 0 0 0",
        "Trough 10 20-30 5-95 5-95",
        "Strait 2 vertical 0 0",
        "Strait 2 horizontal 0 0",
    ],
    "atoll": [
        "Hill 1 75-80 50-60 45-55",
        "Hill 1.5 30-50 25-75 30-70",
        "Hill .5 30-50 25-35 30-70",
        "Smooth 1 0 0 0",
        "Multiply 0.2 25-100 0 0",
        "Hill 0.5 10-20 50-55 48-52",
    ],
    "mediterranean": [
        "Range 4-6 30-80 0-100 0-10",
        "Range 4-6 30-80 0-100 90-100",
        "Hill 6-8 30-50 10-90 0-5",
        "Hill 6-8 30-50 10-90 95-100",
        "Multiply 0.9 land 0 0",
        "Mask -2 0 0 0",
        "Smooth 1 0 0 0",
        "Hill 2-3 30-70 0-5 20-80",
        "Hill 2-3 30-70 95-100 20-80",
        "Trough 3-6 40-50 0-100 0-10",
        "Trough 3-6 40-50 0-100 90-100",
    ],
    "peninsula": [
        "Range 2-3 20-35 40-50 0-15",
        "Add 5 all 0 0",
        "Hill 1 90-100 10-90 0-5",
        "Add 13 all 0 0",
        "Hill 3-4 3-5 5-95 80-100",
        "Hill 1-2 3-5 5-95 40-60",
        "Trough 5-6 10-25 5-95 5-95",
        "Smooth 3 0 0 0",
        "Invert 0.4 both 0 0",
    ],
    "pangea": [
        "Hill 1-2 25-40 15-50 0-10",
        "Hill 1-2 5-40 50-85 0-10",
        "Hill 1-2 25-40 50-85 90-100",
        "Hill 1-2 5-40 15-50 90-100",
        "Hill 8-12 20-40 20-80 48-52",
        "Smooth 2 0 0 0",
        "Multiply 0.7 land 0 0",
        "Trough 3-4 25-35 5-95 10-20",
        "Trough 3-4 25-35 5-95 80-90",
        "Range 5-6 30-40 10-90 35-65",
    ],
    "isthmus": [
        "Hill 5-10 15-30 0-30 0-20",
        "Hill 5-10 15-30 10-50 20-40",
        "Hill 5-10 15-30 30-70 40-60",
        "Hill 5-10 15-30 50-90 60-80",
        "Hill 5-10 15-30 70-100 80-100",
        "Smooth 2 0 0 0",
        "Trough 4-8 15-30 0-30 0-20",
        "Trough 4-8 15-30 10-50 20-40",
        "Trough 4-8 15-30 30-70 40-60",
        "Trough 4-8 15-30 50-90 60-80",
        "Trough 4-8 15-30 70-100 80-100",
        "Invert 0.25 x 0 0",
    ],
    "shattered": [
        "Hill 8 35-40 15-85 30-70",
        "Trough 10-20 40-50 5-95 5-95",
        "Range 5-7 30-40 10-90 20-80",
        "Pit 12-20 30-40 15-85 20-80",
    ],
    "taklamakan": [
        "Hill 1-3 20-30 30-70 30-70",
        "Hill 2-4 60-85 0-5 0-100",
        "Hill 2-4 60-85 95-100 0-100",
        "Hill 3-4 60-85 20-80 0-5",
        "Hill 3-4 60-85 20-80 95-100",
        "Smooth 3 0 0 0",
    ],
    "oldWorld": [
        "Range 3 70 15-85 20-80",
        "Hill 2-3 50-70 15-45 20-80",
        "Hill 2-3 50-70 65-85 20-80",
        "Hill 4-6 20-25 15-85 20-80",
        "Multiply 0.5 land 0 0",
        "Smooth 2 0 0 0",
        "Range 3-4 20-50 15-35 20-45",
        "Range 2-4 20-50 65-85 45-80",
        "Strait 3-7 vertical 0 0",
        "Trough 6-8 20-50 15-85 45-65",
        "Pit 5-6 20-30 10-90 10-90",
    ],
    "fractious": [
        "Hill 12-15 50-80 5-95 5-95",
        "Mask -1.5 0 0 0",
        "Mask 3 0 0 0",
        "Add -20 30-100 0 0",
        "Range 6-8 40-50 5-95 10-90",
    ],
}


def templates(spark: SparkSession, more: dict[str, list[str]] | None = None) -> DataFrame:
    """name, seq, command, args; `more` adds programs of the caller's own."""
    rows = [(name, i, *(lambda w: (w[0], w[1:]))(line.split())) for name, program in (TEMPLATES | (more or {})).items() for i, line in enumerate(program)]
    return spark.createDataFrame(rows, "name string, seq int, command string, args array<string>")


def uniform(seed: int, *key: Column) -> Column:
    """A stateless number in [0, 1) for each key, the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)


def scrambled(seed: int, key: Column) -> Column:
    """A whole number 0..65535 by integer arithmetic alone, which any SQL engine repeats."""
    a = (key * 48271 + seed) % 2147483647
    return F.floor((a * 16807) % 2147483647 / 7).cast("long") % 65536


def jittered_grid(spark: SparkSession, width: int, height: int, spacing: float, seed: int) -> DataFrame:
    """cell_id, x, y: the middle of each square, moved by at most 0.45 of the spacing, two places, inside the map."""
    nx, ny = math.ceil((width - spacing / 2) / spacing), math.ceil((height - spacing / 2) / spacing)
    return jittered(spark.range(nx * ny).withColumnRenamed("id", "cell_id"), width, height, spacing, seed)


def jittered(cells: DataFrame, width: int, height: int, spacing: float, seed: int) -> DataFrame:
    """cells (cell_id from 0 on, row by row), each with a place x, y as jittered_grid() gives it."""
    nx, i = math.ceil((width - spacing / 2) / spacing), F.col("cell_id")
    at = lambda k, n, salt: F.round(F.least(F.lit(float(n)), F.greatest(F.lit(0.0), spacing / 2 + k * spacing + (scrambled(seed + salt, i) / 65535.0 * 2 - 1) * spacing * 0.45)), 2)
    return cells.withColumns({"x": at(i % nx, width, 0), "y": at(F.expr(f"cell_id div {nx}"), height, 977)})


def boundary_points(spark: SparkSession, width: int, height: int, spacing: float) -> DataFrame:
    """x, y of points around the map, one spacing (rounded) outside it and two spacings apart; id numbers them."""
    off, step = -round(spacing), 2 * spacing
    w, h = width - 2 * off, height - 2 * off
    nx, ny = math.ceil(w / step) - 1, math.ceil(h / step) - 1
    across = spark.range(nx).select("id", F.ceil(w * (F.col("id") + 0.5) / nx + off).alias("a"))
    down = spark.range(ny).select("id", F.ceil(h * (F.col("id") + 0.5) / ny + off).alias("a"))
    side = lambda d, first, x, y: d.select((F.col("id") + first).alias("id"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    a = F.col("a")
    top, bottom = side(across, 0, a, F.lit(off)), side(across, nx, a, F.lit(h + off))
    return top.unionAll(bottom).unionAll(side(down, 2 * nx, F.lit(off), a)).unionAll(side(down, 2 * nx + ny, F.lit(w + off), a))


def spacing_of(width: int, height: int, n: int) -> float:
    """The spacing of a grid of about n points."""
    return round(math.sqrt(width * height / n), 2)


def grid_points(spark: SparkSession, width: int, height: int, spacing: float, seed: int) -> DataFrame:
    """cell_id, x, y, is_edge: a jittered grid, and the points around it, numbered from -1 down."""
    own = jittered_grid(spark, width, height, spacing, seed).withColumn("is_edge", F.lit(False))
    return own.unionAll(boundary_points(spark, width, height, spacing).select((-1 - F.col("id")).alias("cell_id"), F.col("x").cast("double"), F.col("y").cast("double"), F.lit(True)))


def packed(cells: DataFrame, distance: DataFrame, edges: DataFrame, spacing: float = 0.0) -> DataFrame:
    """grid_id, x, y, height of a packed world: land, coastal water, three quarters of the next ring, and
    points midway between neighbours on the coast of one kind (from the one with the lesser id), at least `spacing` apart."""
    c = cells.join(distance, "cell_id")
    kept = c.where((F.col("height") >= 20) | F.col("distance").isin(-1, -2)).where((F.col("distance") != -2) | (F.col("cell_id") % 4 != 0))
    own = kept.select(F.col("cell_id").alias("grid_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "height")
    shore = kept.where(F.abs("distance") == 1).select("cell_id", "x", "y", "height", "distance")
    there = shore.select(F.col("cell_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("distance").alias("d2"))
    mid = edges.where("src < dst").join(shore, F.col("src") == F.col("cell_id")).join(there, "dst").where("distance = d2").where((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 >= spacing * spacing)
    return own.unionAll(mid.select(F.col("cell_id").alias("grid_id"), F.round((F.col("x") + F.col("x2")) / 2, 1).alias("x"), F.round((F.col("y") + F.col("y2")) / 2, 1).alias("y"), "height"))


class Alea:
    """Baagøe's Alea generator, for serial stages on the driver whose call order is part of the result."""

    STEP = 2.0**-32

    def __init__(self, seed):
        memory = [0xEFC8249D]
        state = [self._mash(memory, " ") for _ in range(3)]
        for k in range(3):
            state[k] -= self._mash(memory, str(seed))
            state[k] += state[k] < 0
        self.state, self.carry = deque(state, 3), 1

    def _mash(self, memory: list, text: str) -> float:
        n = memory[0]
        for c in text:
            n += ord(c)
            whole = 0.02519603282416938 * n
            n = int(whole) & 0xFFFFFFFF
            product = (whole - n) * n
            n = int(product) & 0xFFFFFFFF
            n += (product - n) * 2.0**32
        memory[0] = n
        return (int(n) & 0xFFFFFFFF) * self.STEP

    def random(self) -> float:
        t = 2091639 * self.state[0] + self.carry * self.STEP
        self.carry = int(t)
        self.state.append(t - self.carry)
        return self.state[2]


TOP, PLACES = 90, 50


class Heightmap:
    """Heights 0..100 on a lattice `wide` cells wide, changed by commands."""

    def __init__(self, wide: int, high: int, seed: int, decay: float = 0.95, line_decay: float = 0.8):
        self.wide, self.high, self.decay, self.line_decay = wide, high, decay, line_decay
        self.rng = np.random.default_rng(seed)
        self.h = np.zeros(wide * high)

    def _around(self, i: int) -> list[int]:
        x = i % self.wide
        return [j for j, ok in ((i - 1, x > 0), (i + 1, x < self.wide - 1), (i - self.wide, i >= self.wide), (i + self.wide, i + self.wide < len(self.h))) if ok]

    def _number(self, spec: str) -> int:
        """'5-10' is any whole number of the range; '1.5' is 1 or, with the chance of its fraction, 2."""
        low, dash, high = spec[1:].partition("-")
        if dash:
            return int(self.rng.integers(int(float(spec[0] + low)), int(float(high)) + 1))
        value = float(spec)
        return int(value) + int(self.rng.random() < value - int(value))

    def _place(self, rx: str, ry: str) -> int:
        at = [min(n - 1, int(n * self.rng.uniform(*(lambda p: (float(p[0]), float(p[-1])))(r.split("-"))) / 100)) for r, n in ((rx, self.wide), (ry, self.high))]
        return at[0] + at[1] * self.wide

    def _blob(self, start: int, top: float) -> np.ndarray:
        """Whole numbers that fall off from the start, ring by ring, until 1."""
        grown = np.zeros(len(self.h), int)
        grown[start] = int(top)
        ring = [start]
        while ring:
            ahead = []
            for i in ring:
                for j in self._around(i):
                    if not grown[j]:
                        grown[j] = int(grown[i] ** self.decay * self.rng.uniform(0.9, 1.1))
                        if grown[j] > 1:
                            ahead.append(j)
            ring = ahead
        return grown

    def _walk(self, start: int, end: int) -> list[int]:
        """Greedy path that sometimes misjudges a distance by half."""
        path, used = [start], {start}
        while path[-1] != end:
            ways = [j for j in self._around(path[-1]) if j not in used]
            if not ways:
                break
            far = [((j % self.wide - end % self.wide) ** 2 + (j // self.wide - end // self.wide) ** 2) * (0.5 if self.rng.random() > 0.85 else 1) for j in ways]
            path.append(ways[int(np.argmin(far))])
            used.add(path[-1])
        return path

    def _ridge(self, path: list[int], top: float, sign: int) -> None:
        ring, used = list(path), set(path)
        while ring and top >= 2:
            for i in ring:
                self.h[i] += sign * top * self.rng.uniform(0.85, 1.15)
            top = top**self.line_decay - 1
            ring = [j for i in ring for j in self._around(i) if j not in used and not used.add(j)]

    def run(self, command: str, *a: str) -> None:
        n = len(self.h)
        if command in ("Hill", "Pit"):
            for _ in range(self._number(a[0])):
                top = self._number(a[1])
                # a hill looks for a place that it won't raise above TOP, PLACES times, and else is left out
                places = (self._place(a[2], a[3]) for _ in range(PLACES if command == "Hill" else 1))
                start = next((p for p in places if command == "Pit" or self.h[p] + top <= TOP), None)
                if start is not None:
                    blob = self._blob(start, top)
                    self.h += blob if command == "Hill" else -blob
        elif command in ("Range", "Trough"):
            for _ in range(self._number(a[0])):
                start = self._place(a[2], a[3])
                self._ridge(self._walk(start, self._place("10-90", "15-85")), self._number(a[1]), 1 if command == "Range" else -1)
        elif command == "Strait":
            down = a[1] == "vertical"
            start, end = (self._place("30-70", "0-0"), self._place("30-70", "100-100")) if down else (self._place("0-0", "30-70"), self._place("100-100", "30-70"))
            ring = set(self._walk(start, end))
            for _ in range(self._number(a[0])):
                for i in ring:
                    self.h[i] = max(0.0, self.h[i]) ** 0.8
                ring |= {j for i in ring for j in self._around(i)}
        elif command == "Smooth":
            new = [(self.h[i] * (float(a[0]) - 1) + (self.h[i] + self.h[self._around(i)].sum()) / (1 + len(self._around(i)))) / float(a[0]) for i in range(n)]
            self.h = np.array(new)
        elif command == "Mask":
            power = float(a[0])
            nx, ny = 2 * (np.arange(n) % self.wide + 0.5) / self.wide - 1, 2 * (np.arange(n) // self.wide + 0.5) / self.high - 1
            edge = (1 - nx**2) * (1 - ny**2)
            self.h = (self.h * (abs(power) - 1) + self.h * (1 - edge if power < 0 else edge)) / abs(power)
        elif command in ("Add", "Multiply"):
            land = a[1] == "land"
            low, high = (20, 100) if land else (0, 100) if a[1] == "all" else map(float, a[1].split("-"))
            on, pivot = (self.h >= low) & (self.h <= high), 20 if land or low == 20 else 0
            if command == "Add":
                self.h[on] = np.maximum(self.h[on] + float(a[0]), pivot) if pivot else self.h[on] + float(a[0])
            else:
                self.h[on] = (self.h[on] - pivot) * float(a[0]) + pivot
        elif command == "Invert":
            if self.rng.random() < float(a[0]):
                grid = self.h.reshape(self.high, self.wide)
                grid = grid[:, ::-1] if a[1] != "y" else grid
                self.h = (grid[::-1] if a[1] != "x" else grid).reshape(-1).copy()
        else:
            raise ValueError(f"unknown command {command}")
        self.h = np.clip(self.h, 0, 100)


def heightmaps(maps: DataFrame, wide: int, high: int, more: dict[str, list[str]] | None = None) -> DataFrame:
    """map_id, cell_id, x, y, height, is_border of maps (map_id, template, seed); one task a map."""
    programs = TEMPLATES | (more or {})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.iloc[0]
        world = Heightmap(wide, high, int(m["seed"]))
        for line in programs[m["template"]]:
            world.run(*line.split())
        i = np.arange(wide * high)
        x, y = i % wide, i // wide
        return pd.DataFrame({"map_id": m["map_id"], "cell_id": i, "x": x, "y": y, "height": np.floor(world.h).astype(int), "is_border": (x == 0) | (x == wide - 1) | (y == 0) | (y == high - 1)})

    return maps.groupBy("map_id").applyInPandas(run, "map_id long, cell_id long, x long, y long, height int, is_border boolean")
