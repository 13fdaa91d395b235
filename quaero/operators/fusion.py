"""Fusing, reranking and boosting ranked lists ``<query_id, item_id, score, rank>``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions import text as tx
from quaero.operators.sizing import fits, items_of_hits, lookup_join, top_per_key
from quaero.options import FusionOptions

SCORE_DIGITS = 6


def rrf_fuse(
    lists: Sequence[tuple[DataFrame, float]], k: int | None = None, rrf_k: int = 60
) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists.

    Ties go to the item that comes first when the lists are read one after the other.
    """
    parts = [
        ranked.select(
            "query_id",
            "item_id",
            (F.lit(float(weight)) / (rrf_k + F.col("rank"))).alias("part"),
            F.struct(F.lit(i).alias("list"), F.col("rank").alias("place")).alias("first"),
        )
        for i, (ranked, weight) in enumerate(lists)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("query_id", "item_id").agg(
        F.sum("part").alias("score"), F.min("first").alias("first")
    )
    ranked = top_per_key(
        fused.withColumn("score", F.round("score", 9)),
        ["query_id"],
        [F.col("score").desc(), F.col("first")],
        k if k is not None else 2**31 - 1,
    )
    return ranked.select("query_id", "item_id", "score", "rank")


def retrieve(
    mode: str,
    dense: Callable[[int], DataFrame],
    lexical: Callable[[int], DataFrame] | None,
    options: FusionOptions = FusionOptions(),
) -> DataFrame:
    """Top hits in mode ``semantic``, ``bm25`` or ``hybrid``.

    The lists are passed as builders ``k -> hits``: one that a mode does not use is never
    planned. Without a lexical side every mode is dense.
    """
    if mode not in ("semantic", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    k = options.top_k
    if lexical is None or mode == "semantic":
        return rrf_fuse([(dense(k), 1.0)], k, options.rrf_k)
    if mode == "bm25":
        return rrf_fuse([(lexical(k), 1.0)], k, options.rrf_k)
    lists = [(dense(k), options.alpha), (lexical(k), 1.0 - options.alpha)]
    return rrf_fuse(lists, k, options.rrf_k)


def lexical_fallback(questions: DataFrame, dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Dense hits where the question has a vector, lexical hits for the others."""
    failed = questions.filter(F.col("vector").isNull()).select("query_id")
    columns = ["query_id", "item_id", "score", "rank"]
    kept = dense.select(*columns).withColumn("method", F.lit("dense"))
    instead = lexical.join(failed, "query_id", "left_semi").select(*columns)
    return kept.unionByName(instead.withColumn("method", F.lit("lexical")))


def overlap_score(question: Column, passage: Column) -> Column:
    """Built-in pair scorer: F1 of the distinct words of both texts."""
    a = F.array_distinct(tx.tokens(F.lower(question)))
    b = F.array_distinct(tx.tokens(F.lower(passage)))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return tx.ratio(2 * shared, F.size(a) + F.size(b))


def rerank_topn(
    hits: DataFrame,
    questions: DataFrame,
    items: DataFrame,
    top_n: int = 3,
    scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """Score every hit against its question and keep the best ``top_n``.

    The scorer is a column function, or a pandas UDF; it sees candidate rows only. If it gives
    null for a question (a failed call) that question keeps its first ``top_n`` as they are.
    """
    few = fits(questions)
    passages = items.select("item_id", F.col("text").alias("passage"))
    asked = questions.select("query_id", F.col("text").alias("question"))
    candidates = lookup_join(hits, asked, ["query_id"], small_fits=few)
    pairs = items_of_hits(passages, candidates, ["item_id"], few)
    scored = pairs.select(
        "query_id",
        "item_id",
        F.col("rank").alias("before"),
        F.round(scorer(F.col("question"), F.col("passage")), SCORE_DIGITS).alias("pair_score"),
    )
    failed = F.max(F.col("pair_score").isNull()).over(Window.partitionBy("query_id"))
    marked = scored.withColumn(
        "score", F.when(failed, -F.col("before").cast("double")).otherwise(F.col("pair_score"))
    )
    ranked = top_per_key(
        marked, ["query_id"], [F.col("score").desc(), F.col("before")], top_n
    )
    return ranked.select("query_id", "item_id", "score", "rank")


def apply_metadata_boost(
    hits: DataFrame, items: DataFrame, wanted: DataFrame, factor: float = 1.5
) -> DataFrame:
    """Multiply the score where the item's field equals the wanted value, then rank again.

    ``items<item_id, field>``, ``wanted<query_id, boost_value>``; values are compared without
    case and accents. A negative score moves down.
    """
    few = fits(wanted)
    fields = items.select("item_id", F.col("field").alias("_field"))
    asked = wanted.select("query_id", "boost_value")
    labelled = lookup_join(hits, asked, ["query_id"], "left", small_fits=few)
    joined = items_of_hits(fields, labelled, ["item_id"], few)
    equal = tx.normalise(F.col("_field").cast("string")) == tx.normalise(
        F.col("boost_value").cast("string")
    )
    boosted = joined.withColumn(
        "score",
        F.round(F.when(equal, F.col("score") * factor).otherwise(F.col("score")), 9),
    ).withColumnRenamed("rank", "before")
    ranked = top_per_key(
        boosted, ["query_id"], [F.col("score").desc(), F.col("before")], 2**31 - 1
    )
    return ranked.select("query_id", "item_id", "score", "rank")


def dedupe_hits(lists: Sequence[DataFrame]) -> DataFrame:
    """Lists read one after the other, first occurrence of an item per question kept."""
    columns = ["query_id", "item_id", "score"]
    union = None
    for i, hits in enumerate(lists):
        part = hits.select(
            *columns, F.struct(F.lit(i).alias("list"), F.col("rank").alias("place")).alias("first")
        )
        union = part if union is None else union.unionByName(part)
    kept = union.groupBy("query_id", "item_id").agg(
        F.min_by("score", "first").alias("score"), F.min("first").alias("first")
    )
    ranked = top_per_key(kept, ["query_id"], [F.col("first")], 2**31 - 1)
    return ranked.select("query_id", "item_id", "score", "rank")


def keyword_coverage(retrieved: DataFrame) -> DataFrame:
    """Share of the expected keywords found in any retrieved text of the question.

    ``retrieved<query_id, keywords array<string>, text>``: found words are collected as a set
    that is never larger than the keyword list.
    """
    found = retrieved.select(
        "query_id",
        "keywords",
        F.explode_outer(
            F.filter("keywords", lambda w: F.contains(F.lower("text"), F.lower(w)))
        ).alias("word"),
    )
    return found.groupBy("query_id", F.size("keywords").cast("bigint").alias("expected")).agg(
        F.count_distinct("word").alias("found")
    ).withColumn("coverage", F.round(tx.ratio(F.col("found"), F.col("expected")), 6))
