"""Registered queries: a Spark builder and, where SQL can say it, its twin for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


class Tables:
    """The given parquet tables of one scale directory."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def query(key: str, twin: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a key, with its SQL twin if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in BUILDERS:
            raise ValueError(f"duplicate query {key}")
        BUILDERS[key] = lambda spark, directory: fn(Tables(spark, directory))
        if twin is not None:
            TWINS[key] = twin
        return fn

    return register
