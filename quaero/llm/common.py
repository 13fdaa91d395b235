"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: white space that separates words: space and the control characters 9 to 13
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a folder in the warehouse takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder, and read them from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: where a row holds a whole text's pieces, fewer rows are read from Parquet, and given to Python, at once
WIDE_ROWS = {
    "spark.sql.parquet.columnarReaderBatchSize": 256,
    "spark.sql.execution.arrow.maxRecordsPerBatch": 512,
}


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder; rows are wide, so few are held at once while they are written."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = {setting: spark.conf.get(setting) for setting in WIDE_ROWS}
    for setting, rows in WIDE_ROWS.items():
        spark.conf.set(setting, str(rows))
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    return spark.read.parquet(folder)


def whole_text(column: str = "text") -> Column:
    """A text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return to the system what this process has freed: a worker outlives its stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library keeps what is freed
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back when its task ends."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
