"""Chunk store: parquet partitioned by source, with vectors as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.operators.sizing import lookup_join


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", by: str = "source") -> None:
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    chunks.write.mode(mode).partitionBy(by).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """True if the store is there and holds rows."""
    try:
        return bool(spark.read.parquet(path).head(1))
    except AnalysisException:
        return False


def clear(spark: SparkSession, path: str) -> None:
    """Leave an empty store behind."""
    if exists(spark, path):
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def get_or_create(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The stored chunks, building them if there are none or a rebuild is forced."""
    if force or not exists(spark, path):
        write_chunks(build(), path, "overwrite")
    return read_chunks(spark, path)


def upsert_chunks(existing: DataFrame, incoming: DataFrame, key: str = "file_id") -> DataFrame:
    """Incoming chunks replace all stored chunks of the same files."""
    replaced = incoming.select(key).distinct()
    kept = lookup_join(existing, replaced, [key], "left_anti")
    return kept.unionByName(incoming)


def file_totals(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("chunks"))
