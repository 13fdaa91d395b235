"""Retrieval quality over judged hits ``<query_id, rank, relevant boolean, ...>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions.text import ratio

METRICS = ("hit", "rr", "precision", "ndcg")


def judge(hits: DataFrame, file_name: Column, pattern: Column) -> DataFrame:
    """Mark a hit relevant if its file name matches the expected pattern, in any case."""
    return hits.withColumn(
        "relevant", F.regexp_like(file_name, F.concat(F.lit("(?iu)"), pattern))
    )


def _ideal(relevant_count: Column) -> Column:
    """Gain of ``n`` relevant hits in the first n places."""
    places = F.when(relevant_count > 0, F.sequence(F.lit(1), relevant_count.cast("int")))
    return F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def per_query(
    judged: DataFrame,
    ks: Sequence[int],
    keys: Sequence[str] = ("query_id",),
    corpus_relevant: str | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """One row per question and cut-off with hit, reciprocal rank, precision and NDCG.

    ``asked<keys>`` names every question: those without any hit then count as misses (all zero).

    Precision divides by the hits returned. The ideal ranking holds the relevant hits found
    within the cut-off; with ``corpus_relevant`` (a column with the number of relevant items in
    the corpus) it holds as many as fit.
    """
    cut = judged.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])))
    gain = F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    inside = F.col("rank") <= F.col("k")
    extra = [F.max(corpus_relevant).alias("_all")] if corpus_relevant else []
    sums = cut.groupBy(*keys, "k").agg(
        F.count_if(inside).alias("returned"),
        F.count_if(inside & F.col("relevant")).alias("n_relevant"),
        F.min(F.when(inside & F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(inside, gain).otherwise(0.0)).alias("dcg"),
        *extra,
    )
    if asked is not None:
        every = asked.select(*keys).withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])))
        sums = every.join(sums, [*keys, "k"], "left").fillna(0, ["returned", "n_relevant", "dcg"])
    ideal_count = F.least(F.col("k"), F.col("_all")) if corpus_relevant else F.col("n_relevant")
    return sums.select(
        *keys,
        "k",
        F.when(F.col("n_relevant") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        ratio(F.col("n_relevant"), F.col("returned")).alias("precision"),
        F.coalesce(F.col("dcg") / _ideal(ideal_count), F.lit(0.0)).alias("ndcg"),
    )


def means(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of every metric with the number of questions."""
    return metrics.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        *[F.round(F.avg(m), 6).alias(m) for m in METRICS],
    )


def by_partition(metrics: DataFrame, partition: str = "partition") -> DataFrame:
    """Means per cut-off, overall and per partition, from one pass."""
    part = F.when(F.grouping(partition) == 1, F.lit("overall")).otherwise(F.col(partition))
    return (
        metrics.rollup("k", partition)
        .agg(
            part.alias("part"),
            F.count("*").alias("n_queries"),
            *[F.round(F.avg(m), 6).alias(m) for m in METRICS],
        )
        .filter(F.col("k").isNotNull())
        .select("k", F.col("part").alias("partition"), "n_queries", *METRICS)
    )


def failures(
    judged: DataFrame,
    k: int,
    name: str,
    keys: Sequence[str] = ("query_id",),
    asked: DataFrame | None = None,
) -> DataFrame:
    """Questions without a relevant hit in the first k, with the first three names retrieved.

    ``asked<keys>`` names every question: those without any hit are failures too, with no names.
    """
    top = F.array_sort(
        F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.col(name).alias("name"))))
    )
    found = judged.groupBy(*keys).agg(
        F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("found"),
        F.concat_ws(", ", F.transform(top, lambda h: h["name"])).alias("top_3"),
    )
    if asked is not None:
        found = asked.select(*keys).join(found, list(keys), "left").fillna(0, ["found"]).fillna("", ["top_3"])
    return found.filter(F.col("found") == 0).drop("found")


def long_form(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``<keys, metric, value>``, one row per metric."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    )
    return metrics.select(*keys, pairs.alias("_m")).select(*keys, "_m.metric", "_m.value")


def metric_delta(base: DataFrame, full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``full - base`` and the change in percent (0 where the base is 0)."""
    b = base.withColumnRenamed("value", "base")
    f = full.withColumnRenamed("value", "full")
    difference = F.col("full") - F.col("base")
    return b.join(f, list(keys)).select(
        *keys,
        "base",
        "full",
        F.round(difference, 6).alias("delta"),
        F.round(ratio(100 * difference, F.col("base")), 4).alias("change_pct"),
    )


def recovered_lost(base: DataFrame, full: DataFrame, key: str = "query_id") -> DataFrame:
    """Questions missed by one of two runs only: ``recovered`` by the second, or ``lost``."""
    recovered = base.select(key).join(full.select(key), key, "left_anti")
    lost = full.select(key).join(base.select(key), key, "left_anti")
    return recovered.withColumn("change", F.lit("recovered")).unionByName(
        lost.withColumn("change", F.lit("lost"))
    )


def first_ranks(judged: DataFrame, out: str) -> DataFrame:
    """First relevant rank per question, null if there is none."""
    return judged.groupBy("query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias(out)
    )


def rank_shift(without: DataFrame, with_filter: DataFrame) -> DataFrame:
    """First relevant rank of two runs per question and what happened to it."""
    both = first_ranks(without, "rank_without").join(
        first_ranks(with_filter, "rank_with"), "query_id", "full"
    )
    shift = F.col("rank_without") - F.col("rank_with")
    outcome = (
        F.when(F.col("rank_without").isNull() & F.col("rank_with").isNull(), "both_miss")
        .when(F.col("rank_without").isNull(), "recovered")
        .when(F.col("rank_with").isNull(), "lost")
        .when(shift > 0, "improved")
        .when(shift == 0, "same")
        .otherwise("worse")
    )
    return both.select("query_id", "rank_without", "rank_with", shift.alias("shift"), outcome.alias("outcome"))


def rank_shift_summary(shifts: DataFrame) -> DataFrame:
    """Counts per outcome with mean and largest shift."""
    return shifts.groupBy("outcome").agg(
        F.count("*").alias("n"),
        F.round(F.avg("shift"), 6).alias("mean_shift"),
        F.max("shift").alias("max_shift"),
    )


def score_answers(
    answers: DataFrame, scored: DataFrame, parts: Sequence[str], scores: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Join cached judge scores by the hash of their parts.

    Returns the answers with their scores, and those still to be scored.
    """
    key = F.sha2(F.concat_ws("|", *parts), 256)
    keyed = answers.withColumn("cache_key", key)
    cached = scored.select("cache_key", *scores).dropDuplicates(["cache_key"])
    return (
        keyed.join(cached, "cache_key"),
        keyed.join(cached.select("cache_key"), "cache_key", "left_anti"),
    )
