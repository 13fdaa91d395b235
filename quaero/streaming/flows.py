"""Structured Streaming forms of the trace log and of document ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from quaero.operators.sizing import lookup_join
from quaero.sources import store


def phase_metrics(
    events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour"
) -> DataFrame:
    """Count and mean per time window and phase of ``<event_key, ts timestamp, phase, ms>``.

    The same function serves a batch and a stream. On a stream, repeated events are removed
    within the watermark and late ones are dropped, so state stays bounded.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_key"])
    else:
        events = events.dropDuplicates(["event_key"])
    return (
        events.groupBy(F.window("ts", window).alias("w"), "phase")
        .agg(F.count("*").alias("n"), F.avg("ms").alias("mean"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "phase", "n", "mean"
        )
    )


def run_phase_metrics(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to ``path``; the checkpoint lets a restarted query go on."""
    return (
        phase_metrics(events)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(
    documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Chunk arriving documents and append them to the store, one folder per micro-batch.

    A batch that is repeated after a failure overwrites its own folder, so no chunk doubles. A
    file that arrives again replaces its chunks when the store is read with :func:`latest_chunks`.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        documents.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_chunks(spark: SparkSession, path: str, key: str = "file_id") -> DataFrame:
    """Chunks of every file from the last batch that brought it."""
    chunks = store.read_chunks(spark, path)
    last = chunks.groupBy(key).agg(F.max("batch").alias("batch"))
    return lookup_join(chunks, last, [key, "batch"]).drop("batch")


TOTALS = "file_id long, version long, chunks long, tokens long, tokens_before long"


def file_totals(chunks: DataFrame) -> DataFrame:
    """Changes of ``<file_id, tokens>`` per file, one row for each micro-batch that brings the file.

    Keyed state holds what the store counts for a file. A file that arrives again replaces its count,
    so ``tokens - tokens_before`` of all changes adds up to the tokens in the store, and the change
    with the highest version is the file as it is. State is one small row per file. Where a file comes
    twice in one micro-batch, the copy with the largest ``arrived`` counts (a column that says when or
    with what a row came, if the chunks have it).
    """
    came = F.col("arrived").cast("string") if "arrived" in chunks.columns else F.lit("")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, chunks_now, tokens_now = "", 0, 0
        for frame in frames:
            for arrived, own in frame.groupby("arrived"):
                if arrived > last:
                    last, chunks_now, tokens_now = arrived, 0, 0
                if arrived == last:
                    chunks_now += len(own)
                    tokens_now += int(own["tokens"].sum())
        version, _, before = state.get if state.exists else (0, 0, 0)
        state.update((version + 1, chunks_now, tokens_now))
        yield pd.DataFrame(
            {"file_id": [key[0]], "version": [version + 1], "chunks": [chunks_now], "tokens": [tokens_now], "tokens_before": [before]}
        )

    return (
        chunks.select("file_id", "tokens", F.coalesce(came, F.lit("")).alias("arrived"))
        .groupBy("file_id")
        .applyInPandasWithState(update, TOTALS, "version long, chunks long, tokens long", "update", GroupStateTimeout.NoTimeout)
    )


def run_file_totals(
    documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Keep the totals of arriving documents; a batch that is repeated overwrites its own changes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        file_totals(chunk(documents))
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def totals_now(changes: DataFrame) -> DataFrame:
    """``<file_id, chunks, tokens>`` of every file after all changes."""
    last = F.max_by(F.struct("chunks", "tokens"), "version").alias("last")
    return changes.groupBy("file_id").agg(last).select("file_id", "last.*")
