"""A world on its own Voronoi graph: jittered points, their cells, heights and rain of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.operators import voronoi
from cartoweave.plans.components import ensure_checkpoint_dir
from cartoweave.sources import generator
from cartoweave.sources import tables as T

#: The map's extent, and the seed of its points.
WIDE, HIGH, SEED = 1000, 600, 7


def voronoi_world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells (cell_id, x, y, area, is_border, height), edges (src, dst) and rain (cell_id, precip), each computed once.

    As many points as the world has cells, to a row of the grid; point k has the height and the rain of cell k, beyond the last from the first on.
    """
    ensure_checkpoint_dir(spark)
    n = T.count_cells(spark, sf_dir)
    spacing = generator.spacing_of(WIDE, HIGH, n)
    built = voronoi.cells(generator.grid_points(spark, WIDE, HIGH, spacing, SEED), spacing).checkpoint()
    given = T.cells(spark, sf_dir).select(F.col("cell_id").alias("_given"), "height").join(T.precipitation(spark, sf_dir).select(F.col("cell_id").alias("_given"), "precip"), "_given")
    cells = built.select("cell_id", "x", "y", "area", "is_border", (F.col("cell_id") % n).alias("_given")).join(given, "_given").drop("_given").checkpoint()
    return cells.drop("precip"), voronoi.edges(built).checkpoint(), cells.select("cell_id", "precip")
