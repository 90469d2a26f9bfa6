"""The edit log as a stream: files of events come in, current state and activity go out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.plans.blocks import shared_folder
from cartoweave.sources.tables import edits_of


def read_edits(spark: SparkSession, path: str, n_cells: int, files_a_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of events in a folder; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    return edits_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path), n_cells)


def activity(edits: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Edits by tumbling window and operation; state older than the watermark goes."""
    at = edits.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", window).alias("w"), "op").agg(F.count("*").alias("n"), F.sum("delta").alias("delta")).select(F.col("w.start").alias("start"), "op", "n", "delta")


def sessions(edits: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Edits by editor in sessions that end after a gap."""
    at = edits.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.session_window("at", gap).alias("w"), "editor").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "editor", "n")


def latest_by_cell(edits: DataFrame) -> DataFrame:
    """The last edit of each cell, as a streaming aggregate (update or complete mode)."""
    last = edits.where("op <> 'noop'").groupBy("cell_id").agg(F.max_by(F.struct("edit_id", "op", "delta"), "edit_id").alias("e"))
    return last.select("cell_id", "e.edit_id", "e.op", "e.delta")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming aggregate over all that is there into a new shared folder and return the whole result of the last batch; nothing goes through the driver."""
    spark, path, last = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/{name}", []

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes the same
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[0]}") if last else spark.createDataFrame([], stream.schema)


def keep_current(edits: DataFrame, path: str, checkpoint: str):
    """Start the fold into a folder: each batch adds its last edits by cell; what is there is never written anew."""

    def add(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes the same
        latest_by_cell(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edits.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last edit of each cell, of all batches so far."""
    last = spark.read.parquet(path).groupBy("cell_id").agg(F.max_by(F.struct("edit_id", "op", "delta"), "edit_id").alias("e"))
    return last.select("cell_id", "e.edit_id", "e.op", "e.delta")
