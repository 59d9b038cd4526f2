"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; the path goes through Spark, whatever store holds it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
