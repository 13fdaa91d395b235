"""Routing, abstention, corrective and SQL behaviour measured over result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.fixed_values import ABSTENTION_PATTERNS, TYPE_TO_SOURCE
from quaero.functions.ranks import nearest_rank_wide
from quaero.functions.text import ratio

CLASSES = tuple(sorted(set(TYPE_TO_SOURCE.values())))


def truth_from_type(kind: Column) -> Column:
    """Expected source of a question type; unknown types expect documents."""
    lookup = F.create_map(*[F.lit(x) for pair in TYPE_TO_SOURCE.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, kind), F.lit("unstructured"))


def accuracy(results: DataFrame, partition: str = "partition") -> DataFrame:
    """Share of right routes, overall and per partition."""
    part = F.when(F.grouping(partition) == 1, "overall").otherwise(F.col(partition))
    right = (F.col("truth") == F.col("predicted")).cast("bigint")
    return results.rollup(partition).agg(
        part.alias("part"),
        F.sum(right).alias("correct"),
        F.count("*").alias("n_queries"),
        F.round(F.avg(right), 6).alias("accuracy"),
    ).select(F.col("part").alias("partition"), "correct", "n_queries", "accuracy")


def confusion(results: DataFrame) -> DataFrame:
    return results.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per known class from ``<truth, predicted, n>``."""
    known = F.array(*[F.lit(c) for c in classes])
    inside = matrix.filter(F.array_contains(known, F.col("truth")) & F.array_contains(known, F.col("predicted")))
    roles = inside.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
            )
        ).alias("r"),
        (F.col("truth") == F.col("predicted")).cast("int").alias("hit"),
        "n",
    )
    listed = matrix.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    sums = roles.groupBy("r.class").agg(
        F.sum(F.col("n") * F.col("r.t") * F.col("hit")).alias("tp"),
        F.sum(F.col("n") * F.col("r.t")).alias("support"),
        F.sum(F.col("n") * F.col("r.p")).alias("claimed"),
    )
    full = listed.join(sums, "class", "left").na.fill(0)
    precision, recall = ratio(F.col("tp"), F.col("claimed")), ratio(F.col("tp"), F.col("support"))
    return full.select(
        "class",
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
        "support",
    )


def confidence_stats(results: DataFrame) -> DataFrame:
    """Confidence of right, wrong and all routes."""
    right = results.withColumn("correct", F.col("truth") == F.col("predicted"))
    group = F.when(F.grouping("correct") == 1, "overall").when(F.col("correct"), "correct").otherwise("incorrect")
    return right.rollup("correct").agg(
        group.alias("group"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
        F.round(F.avg("confidence"), 6).alias("mean"),
        F.count("*").alias("n"),
    ).drop("correct")


def confidence_histogram(results: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    bin_no = F.width_bucket("confidence", F.lit(low), F.lit(high), F.lit(bins).cast("bigint"))
    right = (F.col("truth") == F.col("predicted")).alias("correct")
    return results.groupBy(bin_no.alias("bin"), right).agg(F.count("*").alias("n"))


def routing_errors(results: DataFrame) -> DataFrame:
    return results.filter(F.col("truth") != F.col("predicted"))


def is_abstention(response: Column, patterns: Sequence[str] = ABSTENTION_PATTERNS) -> Column:
    """Empty, or holding one of the phrases in any case."""
    phrase = "(?iu)(?:" + "|".join(patterns) + ")"
    return F.when(F.coalesce(response, F.lit("")) == "", True).otherwise(
        F.regexp_like(response, F.lit(phrase))
    )


def abstention_metrics(results: DataFrame, adversarial: str = "adversarial") -> DataFrame:
    """One row over ``<expected, actual, partition>`` booleans."""
    expected, actual = F.col("expected"), F.col("actual")
    hard = expected & (F.col("partition") == adversarial)
    counts = results.agg(
        F.count("*").alias("n_queries"),
        F.count_if(expected).alias("expected_abstentions"),
        F.count_if(expected & actual).alias("true_positives"),
        F.count_if(expected & ~actual).alias("false_negatives"),
        F.count_if(~expected & actual).alias("false_abstentions"),
        F.count_if(hard).alias("adversarial_expected"),
        F.count_if(hard & actual).alias("adversarial_correct"),
    )
    col = F.col
    return counts.select(
        "*",
        F.round(ratio(col("true_positives"), col("expected_abstentions")), 4).alias("accuracy"),
        F.round(
            ratio(col("false_abstentions"), col("n_queries") - col("expected_abstentions")), 4
        ).alias("false_rate"),
        F.round(ratio(col("adversarial_correct"), col("adversarial_expected")), 4).alias(
            "adversarial_accuracy"
        ),
    )


def abstention_failures(results: DataFrame) -> DataFrame:
    kind = F.when(F.col("expected"), "missed_abstention").otherwise("false_abstention")
    return results.filter(F.col("expected") != F.col("actual")).withColumn("kind", kind)


def corrective_metrics(events: DataFrame) -> DataFrame:
    """Over the ``crag`` records of trace events; kept = graded relevant or ambiguous."""
    record = F.col("crag")
    graded = F.size(record["grading_per_chunk_ms"])
    kept = record["relevant_count"] + record["ambiguous_count"]
    return (
        events.filter(record.isNotNull())
        .agg(
            F.count("*").alias("n_queries"),
            F.round(F.avg(record["relevance_ratio"]), 4).alias("mean_relevance_ratio"),
            F.count_if(record["rewrite_triggered"]).alias("rewrite_count"),
            F.sum(graded).alias("chunks_before"),
            F.sum(kept).cast("bigint").alias("chunks_after"),
        )
        .withColumn("rewrite_rate", F.round(ratio(F.col("rewrite_count"), F.col("n_queries")), 4))
        .withColumn(
            "filtering_rate",
            F.when(
                F.col("chunks_before") > 0,
                F.round(1 - F.col("chunks_after") / F.col("chunks_before"), 4),
            ).otherwise(0.0),
        )
    )


def sql_robustness(events: DataFrame) -> DataFrame:
    """One row over the ``sql`` records: success, first attempt, relaxation, latency of successes."""
    runs = events.filter(F.col("sql").isNotNull()).select("sql.*")
    ok = F.col("success")
    rates = runs.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(ok.cast("double")), 4).alias("success_rate"),
        F.round(F.avg((ok & (F.col("total_attempts") == 1)).cast("double")), 4).alias("first_attempt_rate"),
        F.round(F.avg(F.col("query_relaxed").cast("double")), 4).alias("relaxation_rate"),
        F.round(F.avg(F.when(ok & (F.col("total_ms") > 0), F.col("total_ms"))), 6).alias("mean_ms"),
    )
    timed = runs.filter(ok & (F.col("total_ms") > 0)).select("total_ms")
    ranks = nearest_rank_wide(timed, [], "total_ms", {"p50_ms": 50, "p95_ms": 95})
    place = ranks.select(F.struct("p50_ms", "p95_ms")).scalar()
    return rates.select("*", place["p50_ms"].alias("p50_ms"), place["p95_ms"].alias("p95_ms"))


def attempts_distribution(events: DataFrame) -> DataFrame:
    runs = events.filter(F.col("sql").isNotNull())
    return runs.groupBy(F.col("sql.total_attempts").cast("bigint").alias("attempts")).agg(F.count("*").alias("n"))


def sql_attempts(events: DataFrame) -> DataFrame:
    """One row per attempt."""
    return events.select("query_id", F.explode("sql.attempts").alias("a")).select("query_id", "a.*")


def attempts_by_error(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("error_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("sql_generation_ms"), 6).alias("generation_ms"),
        F.round(F.avg("validation_ms"), 6).alias("validation_ms"),
        F.round(F.avg("execution_ms"), 6).alias("execution_ms"),
    )


def error_report(
    retrieval: DataFrame, routing: DataFrame, abstention: DataFrame
) -> DataFrame:
    """One table ``<section, config, query_id, detail>`` from the three failure lists.

    ``retrieval<config, query_id, detail>``, ``routing`` and ``abstention`` ``<query_id, detail>``.
    """

    def part(df, section):
        config = F.col("config") if "config" in df.columns else F.lit(None).cast("string")
        return df.select(
            F.lit(section).alias("section"),
            config.alias("config"),
            F.col("query_id").cast("string").alias("query_id"),
            "detail",
        )

    return (
        part(retrieval, "failed_retrieval")
        .unionByName(part(routing, "routing_errors"))
        .unionByName(part(abstention, "abstention_failures"))
    )
