"""Relational tables as inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def select_tables(
    names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> list[str]:
    """Include list first (if any), then the exclude list."""
    return [n for n in names if (not include or n in include) and n not in exclude]


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    splits: int = 64,
) -> DataFrame:
    """A database table; with a numeric ``split_on`` column it is read in parallel slices."""
    options = dict(properties or {})
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on is not None:
        if bounds is None:
            raise ValueError("bounds are needed to split a read")
        reader = reader.options(
            partitionColumn=split_on,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(splits),
        )
    return reader.load()


def register_views(frames: dict[str, DataFrame]) -> list[str]:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return sorted(frames)
