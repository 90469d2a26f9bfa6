"""A session for the library's jobs, and what is reused between them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Bytes, as measured by a finished stage, up to which a side of a join is broadcast without being asked for.
MEASURED = 2 << 20


def broadcast_by_measure(spark: SparkSession) -> None:
    """Let joins broadcast a side only by what a stage has measured, not by the planner's estimate from the size of compressed files.

    Parquet files of whole numbers, and arrays in them, are tens of times their size in memory, so that estimates below the
    threshold become broadcasts of hundreds of MB, all by way of the driver.  Broadcasts that are asked for stay, and a lower threshold, too.
    It holds for the session, as plans are made when a result is read.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(planned) == "-1":
        return
    before = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(measured, None) or spark.conf.get(planned))
    spark.conf.set(measured, str(min(before, MEASURED)))
    spark.conf.set(planned, "-1")


def session(name: str = "cartoweave", **conf: str) -> SparkSession:
    """Adaptive execution splits hot partitions and merges small ones; all else is the cluster's own configuration."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    broadcast_by_measure(spark)
    return spark


def reuse(spark: SparkSession, folder: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gave for the same configuration before, from Parquet, or else made now and kept.

    A folder without its success marker was not written whole, and is made anew.
    """
    path = f"{folder}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:20]}"
    sc = spark.sparkContext
    marker = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(sc._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tables_there(spark: SparkSession, *names: str) -> DataFrame:
    """(name, there): a probe of the catalog."""
    return spark.createDataFrame([(n, spark.catalog.tableExists(n)) for n in names], "name string, there boolean")


def add_functions(spark: SparkSession) -> None:
    """The SQL function safe_extrude(x, y, side, height): the top of a block as WKT, or null for what is none."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION safe_extrude(x DOUBLE, y DOUBLE, side DOUBLE, height DOUBLE) RETURNS STRING
      RETURN CASE WHEN x IS NULL OR y IS NULL OR isnan(x) OR isnan(y) OR NOT side > 0 OR height IS NULL THEN NULL ELSE
        format_string('POLYGON Z((%1$.1f %2$.1f %5$.1f,%3$.1f %2$.1f %5$.1f,%3$.1f %4$.1f %5$.1f,%1$.1f %4$.1f %5$.1f,%1$.1f %2$.1f %5$.1f))', x, y, x + side, y + side, height) END""")


def add_layer_check(spark: SparkSession, layers: dict[str, DataFrame]) -> None:
    """The SQL table function layer_check(): layer, view_there, n, sample, a row for each of layers, which become views named <layer>_layer."""
    rows = []
    for name, rows_ in layers.items():
        rows_.createOrReplaceTempView(f"{name}_layer")
        rows.append(f"SELECT '{name}' AS layer, true AS view_there, (SELECT count(*) FROM {name}_layer) AS n, (SELECT min_by(wkt, id) FROM {name}_layer) AS sample")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION layer_check() RETURNS TABLE(layer STRING, view_there BOOLEAN, n BIGINT, sample STRING) RETURN {' UNION ALL '.join(rows)}")
