"""Latency statistics over phase timings ``<query_id, phase, ms, ...>`` of a trace log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.fixed_values import PHASES
from quaero.functions.ranks import nearest_rank, nearest_rank_wide
from quaero.functions.text import ratio
from quaero.operators.sizing import lookup_join, one_row

DIGITS = 9
LADDER = (50, 75, 90, 95, 99)


def explode_phases(events: DataFrame) -> DataFrame:
    """Phase timings of trace events with a ``phases`` map."""
    others = [c for c in events.columns if c != "phases"]
    return events.select(*others, F.explode("phases").alias("phase", "ms"))


def phase_position(phase: Column) -> Column:
    """Known phases in their order, all others after them."""
    known = F.array_position(F.array(*[F.lit(p) for p in PHASES]), phase)
    return F.when(known > 0, known).otherwise(len(PHASES) + 1).cast("bigint")


def summary(timings: DataFrame, by: Sequence[str], ms: str = "ms") -> DataFrame:
    """Mean, median, p95, sample deviation (0 for a single value), count, min and max."""
    moments = timings.groupBy(*by).agg(
        F.round(F.avg(ms), DIGITS).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(ms), F.lit(0.0)), DIGITS).alias("stddev"),
        F.count(ms).alias("n"),
        F.round(F.min(ms), DIGITS).alias("min"),
        F.round(F.max(ms), DIGITS).alias("max"),
    )
    ranks = nearest_rank_wide(timings, by, ms, {"median": 50, "p95": 95})
    return moments.join(ranks, list(by))


def by_phase(timings: DataFrame) -> DataFrame:
    return summary(timings, ["phase"]).withColumn("position", phase_position(F.col("phase")))


def by_type(totals: DataFrame, dataset: DataFrame) -> DataFrame:
    """Total latency per question type; questions outside the data set count as ``?``."""
    typed = lookup_join(totals, dataset.select("query_id", "type"), ["query_id"], "left")
    return summary(typed.withColumn("type", F.coalesce("type", F.lit("?"))), ["type"])


def phase_percentages(events: DataFrame, leaf_phases: Sequence[str] | None = None) -> DataFrame:
    """Share of every phase in the summed total of events with a positive total.

    Nested phases count in their parent too; ``leaf_phases`` restricts the report.
    """
    timed = events.filter(F.col("phases")["total_ms"] > 0)
    total = one_row(timed.agg(F.sum(F.col("phases")["total_ms"]).alias("total")))["total"]
    parts = explode_phases(timed).filter(F.col("phase") != "total_ms")
    if leaf_phases is not None:
        parts = parts.filter(F.col("phase").isin(*leaf_phases))
    sums = parts.groupBy("phase").agg(F.sum("ms").alias("ms"))
    return sums.select("phase", F.round(ratio(F.col("ms") * 100, total), DIGITS).alias("share_pct"))


def percentile_ladder(timings: DataFrame, by: Sequence[str], percents=LADDER) -> DataFrame:
    return nearest_rank(timings, by, "ms", percents)


def run_variance(timings: DataFrame) -> DataFrame:
    """Per question and phase over repeated runs; only questions with two events or more.

    ``timings<query_id, event, phase, ms>``.
    """
    repeated = (
        timings.groupBy("query_id", "event").agg(F.count("*").alias("_c"))
        .groupBy("query_id").agg(F.count("*").alias("_events"))
        .filter(F.col("_events") >= 2)
        .select("query_id")
    )
    stats = timings.groupBy("query_id", "phase").agg(
        F.avg("ms").alias("mean"),
        F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("stddev"),
        F.count("*").alias("n"),
    )
    return stats.join(repeated, "query_id", "left_semi")


def variance_of_means(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("phase").agg(
        F.round(F.avg("mean"), DIGITS).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("mean"), F.lit(0.0)), DIGITS).alias("stddev"),
        F.count("*").alias("n_queries"),
    )


def enrich_events(events: DataFrame, dataset: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Add data set attributes, ``?`` where unknown; values the events already have stay."""
    own = [a for a in attributes if a in events.columns]
    other = dataset.select(
        "query_id", *[F.col(a).cast("string").alias(f"_{a}") for a in attributes]
    )
    joined = lookup_join(events, other, ["query_id"], "left")
    filled = {
        a: F.coalesce(*([F.col(a)] if a in own else []), F.col(f"_{a}"), F.lit("?"))
        for a in attributes
    }
    return joined.withColumns(filled).drop(*[f"_{a}" for a in attributes])


def filter_events(events: DataFrame, **wanted) -> DataFrame:
    """Events with the given attribute values; empty wishes do not filter."""
    for name, value in wanted.items():
        if value:
            events = events.filter(F.col(name) == value)
    return events


def run_lines(events: DataFrame) -> DataFrame:
    """One line per event ``<query_id, source, total_ms, error>``."""
    return events.withColumn(
        "line",
        F.concat_ws(
            "  ",
            F.col("query_id").cast("string"),
            F.coalesce("source", F.lit("?")),
            F.round(F.coalesce("total_ms", F.lit(0.0)), 1).cast("decimal(18,1)").cast("string"),
            F.when(F.coalesce("error", F.lit("")) != "", "ERROR").otherwise("ok"),
        ),
    )


def error_and_retry_rates(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of events with an error, and attempts beyond the first."""
    return events.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("error").isNotNull().cast("double")), 6).alias("error_rate"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"),
    )
