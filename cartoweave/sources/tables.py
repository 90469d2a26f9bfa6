"""The world's tables, derived from the given Parquet tables with integer arithmetic.

A world is a lattice of cells WIDTH wide; an id of 0 means "none" for owners, heights below SEA
are water.  The number of cells is counted, never assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the lattice of cells, and the height that parts water from land.
WIDTH, SEA = 40, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_cells(spark: SparkSession, sf_dir: str) -> int:
    """One number, from the Parquet footers."""
    return table(spark, sf_dir, "part").count()


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, x, y, height 2..100, is_border (lacks one of four neighbours)."""
    n = count_cells(spark, sf_dir)
    i = F.col("p_partkey")
    border = (i % WIDTH == 0) | (i % WIDTH == WIDTH - 1) | (i < WIDTH) | (i + WIDTH >= n) | (i + 1 >= n)
    return table(spark, sf_dir, "part").select(i.alias("cell_id"), (i % WIDTH).alias("x"), F.expr(f"p_partkey div {WIDTH}").alias("y"), (F.col("p_size") * 2).alias("height"), border.alias("is_border"))


def lattice_edges(cells: DataFrame, n: int) -> DataFrame:
    """(src, dst) of the four-neighbour lattice, both directions, without a join."""
    i = F.col("cell_id")
    near = F.filter(F.array(F.when(i % WIDTH > 0, i - 1), F.when((i % WIDTH < WIDTH - 1) & (i + 1 < n), i + 1), F.when(i >= WIDTH, i - WIDTH), F.when(i + WIDTH < n, i + WIDTH)), lambda x: x.isNotNull())
    return cells.select(i.alias("src"), F.explode(near).alias("dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_edges(cells(spark, sf_dir), count_cells(spark, sf_dir))


def precipitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, precip 0..255 for every cell."""
    rain = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.sum("l_quantity").cast("long").alias("q"))
    return cells(spark, sf_dir).select("cell_id").join(rain, "cell_id", "left").select("cell_id", F.least(F.lit(255), F.expr("coalesce(q, 0) div 5")).cast("long").alias("precip"))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cell_id, x, y, population, state_id, culture_id, is_capital, kind, name."""
    n = count_cells(spark, sf_dir)
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    cell = F.col("c_custkey") * 7 % n
    capitals = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("_n")).agg(F.min("c_custkey").alias("_first"))
    c = c.join(F.broadcast(capitals), F.col("c_nationkey") == F.col("_n"))
    population = F.floor("c_acctbal") + 1000
    kind = F.when(population > 8000, "city").when(population > 4000, "town").otherwise("village")
    return c.select(F.col("c_custkey").alias("id"), cell.alias("cell_id"), (cell % WIDTH).alias("x"), F.floor(cell / WIDTH).alias("y"), population.alias("population"), F.col("c_nationkey").alias("state_id"), F.col("n_regionkey").alias("culture_id"), (F.col("c_custkey") == F.col("_first")).alias("is_capital"), kind.alias("kind"), F.col("c_name").alias("name"))


def owners(cells: DataFrame) -> DataFrame:
    """cell_id, state_id, culture_id, religion_id; water belongs to nobody."""
    own = lambda k: F.when(F.col("height") >= SEA, k).otherwise(0).cast("long")
    return cells.select("cell_id", own(F.col("cell_id") % 25 + 1).alias("state_id"), own(F.expr("cell_id div 7") % 5 + 1).alias("culture_id"), own(F.expr("cell_id div 3") % 4).alias("religion_id"))


def river_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river_id, seq, cell_id, x, y, height: the ordered path of each river."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("river_id"), F.row_number().over(w).alias("seq"), F.col("l_partkey").alias("cell_id"))
    # the path is small, the cells too: no hint, the planner sees both sizes
    return rows.join(cells(spark, sf_dir).select("cell_id", "x", "y", "height"), "cell_id").select("river_id", "seq", "cell_id", "x", "y", "height")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edit_id, ts, editor, op, cell_id, delta: an append-only log."""
    n = count_cells(spark, sf_dir)
    return edits_of(table(spark, sf_dir, "events"), n)


def edits_of(events: DataFrame, n: int) -> DataFrame:
    op = F.expr("CASE event_type WHEN 'click' THEN 'adjust_height' WHEN 'view' THEN 'set_height' WHEN 'purchase' THEN 'smooth' WHEN 'signup' THEN 'set_biome' ELSE 'noop' END")
    return events.select(F.col("event_id").alias("edit_id"), "ts", F.col("user_id").alias("editor"), op.alias("op"), (F.col("event_id") % n).alias("cell_id"), F.floor("value").alias("delta"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, name, n_nations: the dimension of maps."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    counts = n.groupBy("n_regionkey").agg(F.count("*").alias("n_nations"))
    return r.join(counts, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("map_id"), F.col("r_name").alias("name"), F.coalesce("n_nations", F.lit(0)).cast("long").alias("n_nations"))
