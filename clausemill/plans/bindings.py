"""The test tables in the shapes of the operators (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lease is a source, a page one of its documents, numbered by its id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("lease_id"), F.col("doc_id").cast("string").alias("source"), (F.col("doc_id") + 1).alias("page"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates): every vector whose id is divisible by 20 asks all of its label, which is the lease."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("lease_id"), "embedding")
    return rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), rows


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("client_key"), F.col("event_type").alias("status"), F.col("value").alias("latency_ms"))
