"""A stored world: tables partitioned by map and square, in snapshots that a manifest names whole or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables that may be scanned, in the order in which they are written.
TABLES = ("maps", "cultures", "religions", "states", "settlements", "rivers", "biomes", "climate", "cells")
#: Side of a square; tables with x and y are partitioned by squares of this size.
SQUARE = 64
# What a column of a table is if it is missing or null; a text with {} names the row's id.
DEFAULTS = {
    "cultures": {"name": "Culture {}", "color": "#808080", "type": "Generic", "expansionism": 1.0, "center": 0, "name_base": 0, "population": 0},
    "religions": {"name": "Religion {}", "color": "#808080", "type": "Folk", "form": "Shamanism", "expansion": "global", "expansionism": 1.0, "center": 0},
    "states": {"name": "State {}", "color": "#808080", "government_type": None, "state_type": None, "expansionism": 1.0, "center": 0, "population": 0},
    "biomes": {"name": "Biome {}", "classification": None, "temperature_band": 0, "moisture_band": 0, "habitability": 50, "movement_cost": 1, "avg_temperature": 15.0, "avg_precipitation": 500.0},
    "maps": {"name": "Map {}", "width": 0, "height": 0, "cells_count": 0, "config_json": "{{}}"},
}
#: Keys between tables of one map: table, column, the table meant, its key.
KEYS = (
    ("settlements", "cell_id", "cells", "cell_id"), ("settlements", "state_id", "states", "state_id"), ("settlements", "culture_id", "cultures", "culture_id"),
    ("cells", "state_id", "states", "state_id"), ("cells", "culture_id", "cultures", "culture_id"), ("cells", "religion_id", "religions", "religion_id"),
    ("rivers", "cell_id", "cells", "cell_id"), ("climate", "cell_id", "cells", "cell_id"),
)
_KINDS = {str: "string", float: "double", int: "long", type(None): "string"}


def conform(name: str, rows: DataFrame, ident: str) -> DataFrame:
    """ident, the table's columns with their defaults for what is missing or null, and then the other columns of rows."""
    out = []
    for column, default in DEFAULTS[name].items():
        kind = _KINDS[type(default)]
        value = F.format_string(default.replace("{}", "%d").replace("{{%d}}", "{}"), F.col(ident)) if isinstance(default, str) else F.lit(default)
        given = F.col(f"`{column}`").cast(kind) if column in rows.columns else F.lit(None).cast(kind)
        out.append(F.coalesce(given, value.cast(kind)).alias(column))
    return rows.select(ident, *out, *[f"`{c}`" for c in rows.columns if c != ident and c not in DEFAULTS[name]])


def placed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (cell_id, x, y) with the point of their cell, or their own where the cell is not there."""
    point = cells.select("cell_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    found = rows.join(point, "cell_id", "left").withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")})
    return found.select(*rows.columns)


def _context(spark: SparkSession, path: str):
    """The file context of a path, a maker of paths, and what renames without replacing."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    at = lambda *parts: fs.Path("/".join((path, *parts)))
    return fs.FileContext.getFileContext(at().toUri(), sc._jsc.hadoopConfiguration()), at, sc._gateway.new_array(fs.Options.Rename, 0)


def dangling(tables: dict[str, DataFrame]) -> dict[str, int]:
    """`table.column` -> the number of rows that name a row which is not in the table meant, for keys of KEYS between the given tables; 0 and null name nobody."""
    found = {}
    for table, column, other, key in KEYS:
        if table in tables and other in tables and {"map_id", column} <= set(tables[table].columns) and {"map_id", key} <= set(tables[other].columns):
            named = tables[table].where(F.col(column) != 0).groupBy("map_id", F.col(column).cast("long").alias("_key")).agg(F.count("*").alias("n"))
            n = named.join(tables[other].select("map_id", F.col(key).cast("long").alias("_key")), ["map_id", "_key"], "left_anti").agg(F.sum("n")).first()[0]
            if n:
                found[f"{table}.{column}"] = n
    return found


def save_world(tables: dict[str, DataFrame], path: str, version: str) -> dict:
    """Write each table to a new folder, partitioned by map_id and, with x and y, by square; then name them all in one manifest, which is returned.

    The manifest is renamed into place, so readers see all tables or none, also when a version is saved again: it
    then has the tables of this save and no others, and is the last one.  Who has pinned an older manifest goes on reading its files until
    expire().  Keys between the tables are checked on what was written; where one names nothing, ValueError is raised and there is no manifest.
    """
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    spark = next(iter(tables.values())).sparkSession
    folders, schemas = {}, {}
    for name in TABLES:
        if name in tables:
            rows, by = tables[name], ["map_id"]
            if {"x", "y"} <= set(rows.columns):
                rows = rows.withColumn("square_x", F.floor(F.col("x") / SQUARE).cast("int")).withColumn("square_y", F.floor(F.col("y") / SQUARE).cast("int"))
                by += ["square_x", "square_y"]
            folders[name] = f"{version}/{name}/{uuid.uuid4().hex}"
            # an empty table has no file to tell its columns
            schemas[name] = rows.schema.jsonValue()
            rows.write.partitionBy(*by).parquet(f"{path}/{folders[name]}")
    manifest = {"version": version, "tables": folders, "schemas": schemas}
    wrong = dangling({name: read(spark, path, name, manifest) for name in folders})
    if wrong:
        raise ValueError(f"keys that name nothing: {wrong}")
    return _commit(spark, path, manifest)


def _commit(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Put a manifest after the last one; of two that are saved at once, one takes the next number."""
    context, at, none = _context(spark, path)
    temporary = at("_manifests", f".{uuid.uuid4().hex}")
    files = temporary.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at("_manifests"))
    number = max([m["number"] for m in snapshots(spark, path)], default=0)
    while True:
        number += 1
        out = files.create(temporary, True)
        out.write(json.dumps(manifest | {"number": number}).encode())
        out.close()
        try:
            context.rename(temporary, at("_manifests", f"{number:012d}.json"), none)
            return manifest | {"number": number}
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise


def snapshots(spark: SparkSession, path: str) -> list[dict]:
    """The manifests (number, version, tables: name -> folder, schemas: name -> columns) in the order in which they were saved, one a save that hasn't expired."""
    context, at, _ = _context(spark, path)
    if not context.util().exists(at("_manifests")) or not any(f.getPath().getName().endswith(".json") for f in context.util().listStatus(at("_manifests"))):
        return []
    rows = spark.read.text(f"{path}/_manifests", wholetext=True, pathGlobFilter="*.json").collect()
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["number"])


def pin(spark: SparkSession, path: str, version: str | None = None) -> dict:
    """The last manifest, or the last of a version: what is read by it is of one save."""
    found = [m for m in snapshots(spark, path) if version in (None, m["version"])]
    if not found:
        raise ValueError(f"nothing is saved: {version or path}")
    return found[-1]


def versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions in the order in which they were last saved."""
    last = {m["version"]: m["number"] for m in snapshots(spark, path)}
    return sorted(last, key=last.get)


def expire(spark: SparkSession, path: str, keep: int) -> int:
    """Forget all manifests but the last `keep`, then delete the folders that only they name; how many folders went."""
    if keep < 1:
        raise ValueError("one manifest must stay")
    every = snapshots(spark, path)
    old, kept = every[:-keep], every[-keep:]
    gone = {f for m in old for f in m["tables"].values()} - {f for m in kept for f in m["tables"].values()}
    context, at, _ = _context(spark, path)
    for m in old:
        context.delete(at("_manifests", f"{m['number']:012d}.json"), False)
    for folder in sorted(gone):
        context.delete(at(folder), True)
    return len(gone)


def read(spark: SparkSession, path: str, table: str, at: dict | None = None) -> DataFrame:
    """A whole table of a pinned manifest, or of the last one."""
    if table not in TABLES:
        raise ValueError(f"no such table: {table}")
    at = at or pin(spark, path)
    if table not in at["tables"]:
        raise ValueError(f"the snapshot has no {table}")
    return spark.read.schema(StructType.fromJson(at["schemas"][table])).parquet(f"{path}/{at['tables'][table]}")


def scan(spark: SparkSession, path: str, table: str, map_id: int, box: tuple | None = None, at: dict | None = None) -> DataFrame:
    """A table of one map, of a pinned manifest or of the last one: partition pruning by map_id and squares, and a box on x, y."""
    out = read(spark, path, table, at).where(F.col("map_id") == map_id)
    if box is not None:
        x0, y0, x1, y1 = box
        if "square_x" in out.columns:
            out = out.where(F.col("square_x").between(x0 // SQUARE, x1 // SQUARE) & F.col("square_y").between(y0 // SQUARE, y1 // SQUARE))
        out = out.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return out.drop("square_x", "square_y")


def forget(spark: SparkSession, path: str, version: str, table: str, map_id: int) -> DataFrame:
    """The table without a map, for a new version."""
    return read(spark, path, table, pin(spark, path, version)).where(F.col("map_id") != map_id).drop("square_x", "square_y")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """folder, n, bytes of the files below the path, from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
