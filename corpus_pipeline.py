"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from cartoweave.llm.common import shared_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base counts or lost too many words."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds too go; a document that is left without a word goes."""
    index = line_dedup.deduplicated(docs, shared_path(spark, "lines"))
    kept = line_dedup.drop_lines(docs, index.decisions(), with_text=True).withColumn("n_chars", F.length("text").cast("long"))
    return kept.where(r"n_dropped = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return simhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches: a row for each piece of a document, with its tokens' span, bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("simhash", near), ("decontamination", leaks), ("packing", pack)]
#: XXH64 fingerprints and their components cannot be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
