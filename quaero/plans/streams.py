"""Streaming forms, run as bounded streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.operators import chunking as ch
from quaero.plans.corpus import CHUNKS, work_folder
from quaero.plans.registry import query
from quaero.streaming import flows


def arriving(t, name, files=None):
    """A given table as a stream, ``files`` of it at once; it may be one file or a folder of files."""
    reader = t.spark.readStream.schema(getattr(t, name).schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    # as a pattern: the source takes a plain path for a folder
    return reader.parquet(f"{t.directory}/{name}.parque[t]")


def as_events(df):
    return df.select(
        F.col("event_id").alias("event_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("phase"),
        F.col("value").alias("ms"),
    )


def out(df):
    return df.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "phase",
        "n",
        F.round("mean", 9).alias("mean"),
    )


WINDOWS = """
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  event_type AS phase, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY ALL)"""


@query("trace_metrics_batch", f"WITH {WINDOWS} SELECT * FROM w")
def trace_metrics_batch(t):
    return out(flows.phase_metrics(as_events(t.events)))


@query(
    "stream_trace_metrics",
    f"WITH {WINDOWS} SELECT * FROM w WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
)
def stream_trace_metrics(t):
    """The stream appends only windows that the watermark has closed."""
    stream = arriving(t, "events")
    path = work_folder(t.spark, "phase-metrics")
    flows.run_phase_metrics(as_events(stream), path, path + "-checkpoint").awaitTermination()
    return out(t.spark.read.parquet(path))


@query(
    "stream_ingest_chunks",
    f"WITH {CHUNKS} SELECT file_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM chunks GROUP BY file_id",
)
def stream_ingest_chunks(t):
    docs = arriving(t, "documents", 100).select(F.col("doc_id").alias("file_id"), "source", "text")
    path = work_folder(t.spark, "stream-chunks")
    flows.ingest_stream(docs, ch.chunk_char_windows, path, path + "-checkpoint").awaitTermination()
    stored = flows.latest_chunks(t.spark, path)
    return stored.groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


@query(
    "stream_file_totals",
    f"WITH {CHUNKS} SELECT file_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM chunks GROUP BY file_id",
)
def stream_file_totals(t):
    """Totals of every file, kept by a stream that brings each document twice: the second replaces the first."""
    folder = work_folder(t.spark, "arrivals")
    docs = t.documents.select(F.col("doc_id").alias("file_id"), "source", "text")
    docs.write.parquet(folder)
    docs.write.mode("append").parquet(folder)
    path = work_folder(t.spark, "file-totals")
    stream = t.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 100).parquet(folder)
    came = F.concat(F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS"), F.lit(" "), "_metadata.file_name")
    arrivals = stream.select("*", came.alias("arrived"))
    flows.run_file_totals(arrivals, ch.chunk_char_windows, path, path + "-checkpoint").awaitTermination()
    return flows.totals_now(t.spark.read.parquet(path))
