"""Route questions to documents, tables or both: override tags, keywords, model, default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.fixed_values import OVERRIDE_TAGS
from quaero.functions import text as tx
from quaero.options import RouterOptions

_TAG = r"(?iu)(?<![\p{L}\p{N}_])(" + OVERRIDE_TAGS + r")(?![\p{L}\p{N}_])"


def _route(source, confidence, method: str, reasoning, clean_query=None) -> Column:
    return F.struct(
        source.alias("source"),
        confidence.cast("double").alias("confidence"),
        F.lit(method).alias("method"),
        reasoning.alias("reasoning"),
        (F.lit(None).cast("string") if clean_query is None else clean_query).alias("clean_query"),
    )


def override_tag(question: Column) -> Column:
    """First source tag in the question, or empty."""
    return F.regexp_extract(question, _TAG, 1)


def override(question: Column, tag: Column) -> Column:
    """Route struct if a source tag was found, else null."""
    plain = tx.normalise(tag)
    source = (
        F.when(F.contains(plain, F.lit("hibrido")), "hybrid")
        .when(F.contains(plain, F.lit("no")), "unstructured")
        .otherwise("structured")
    )
    bare = F.regexp_replace(F.regexp_replace(question, _TAG, ""), r"^\s+|\s+$", "")
    clean = F.regexp_replace(bare, r"\s{2,}", " ")
    reasoning = F.concat(F.lit("Manual override tag '"), tag, F.lit("' detected"))
    return F.when(tag != "", _route(source, F.lit(1.0), "manual_override", reasoning, clean))


def keyword_hits(question: Column, options: RouterOptions) -> tuple[Column, Column]:
    """Keywords of each side contained in the normalised question."""
    norm = tx.normalise(question)

    def count(words) -> Column:
        return tx.count_contained(norm, [tx.normalise_literal(w) for w in words])

    return count(options.structured_keywords), count(options.unstructured_keywords)


def by_keywords(structured: Column, unstructured: Column, options: RouterOptions) -> Column:
    """Route struct if one side clearly wins, else null."""
    share = tx.ratio(F.greatest(structured, unstructured), structured + unstructured)
    reasoning = F.concat(
        F.lit("Keyword routing: "),
        structured.cast("string"),
        F.lit(" structured hits, "),
        unstructured.cast("string"),
        F.lit(" unstructured hits"),
    )
    decided = (structured + unstructured > 0) & (share >= options.keyword_threshold)
    tables = tx.ratio(structured, structured + unstructured) >= options.keyword_threshold
    side = F.when(tables, "structured").otherwise("unstructured")
    return F.when(decided, _route(side, share, "rules", reasoning))


def parse_response(response: Column) -> tuple[Column, Column]:
    """Source and confidence named by a model response; unreadable ones give null.

    Only ``0.x`` is read as a confidence, so ``1.0`` counts as the default 0.80.
    """
    shouted = F.upper(response)
    source = (
        F.when(F.contains(shouted, F.lit("HYBRID")), "hybrid")
        .when(F.contains(shouted, F.lit("UNSTRUCTURED")), "unstructured")
        .when(F.contains(shouted, F.lit("STRUCTURED")), "structured")
    )
    number = F.regexp_extract(response, r"(0\.\d+)", 1).try_cast("double")
    confidence = F.when(source.isNotNull(), F.coalesce(number, F.lit(0.80))).otherwise(0.0)
    return source, confidence


def widen_if_unsure(source: Column, confidence: Column, options: RouterOptions) -> Column:
    """Below the confidence threshold ask both sources."""
    return F.when(confidence < options.confidence_threshold, "hybrid").otherwise(source)


def by_response(response: Column, options: RouterOptions) -> Column:
    source, confidence = parse_response(response)
    final = widen_if_unsure(source, confidence, options)
    reasoning = F.concat(F.lit("LLM classified query as "), final)
    return F.when(source.isNotNull(), _route(final, confidence, "llm", reasoning))


def by_default(reason: str, options: RouterOptions) -> Column:
    return _route(F.lit(options.default_source), F.lit(1.0), "default", F.lit(reason))


def _cheap_layers(questions: DataFrame, options: RouterOptions) -> DataFrame:
    """Add ``route`` as far as tags, switches and keywords decide it.

    Tag and keyword counts are columns of an earlier projection, so each is evaluated once.
    """
    structured, unstructured = keyword_hits(F.col("text"), options)
    counted = questions.select(
        "query_id",
        "text",
        override_tag(F.col("text")).alias("_tag"),
        structured.alias("_structured"),
        unstructured.alias("_unstructured"),
    )
    tagged = override(F.col("text"), F.col("_tag"))
    if not options.enabled:
        cheap = F.coalesce(tagged, by_default("Router disabled", options))
    elif not options.sql_enabled:
        reason = F.lit("SQL not enabled, using document retrieval")
        cheap = F.coalesce(tagged, _route(F.lit("unstructured"), F.lit(1.0), "default", reason))
    else:
        cheap = F.coalesce(tagged, by_keywords(F.col("_structured"), F.col("_unstructured"), options))
    return counted.select("query_id", "text", cheap.alias("route"))


def route_questions(
    questions: DataFrame, options: RouterOptions, responses: DataFrame | None = None
) -> DataFrame:
    """Layered decision for ``questions<query_id, text>``.

    ``responses<query_id, response>`` are model answers; they are only looked up for questions
    that the cheap layers left open (use :func:`undecided` to ask a model for just those).
    """
    routed = _cheap_layers(questions, options).drop("text")
    fallback = by_default("LLM unavailable, using default", options)
    if responses is None:
        return routed.select("query_id", F.coalesce("route", fallback).alias("route")).select(
            "query_id", "route.*"
        )
    answered = routed.filter(F.col("route").isNull()).select("query_id").join(responses, "query_id", "left")
    late = answered.select(
        "query_id", F.coalesce(by_response(F.col("response"), options), fallback).alias("route")
    )
    return routed.filter(F.col("route").isNotNull()).unionByName(late).select("query_id", "route.*")


def undecided(questions: DataFrame, options: RouterOptions) -> DataFrame:
    """Questions that need the model."""
    return _cheap_layers(questions, options).filter(F.col("route").isNull()).drop("route")


def distribution(routes: DataFrame) -> DataFrame:
    return routes.groupBy("source", "method").agg(F.count("*").alias("n"))


def empty_result_fallback(
    routes: DataFrame, structured: DataFrame, documents: DataFrame, strategy: str = "try_unstructured"
) -> DataFrame:
    """Where the final answer comes from for questions routed to tables.

    ``structured<query_id, success, row_count>``, ``documents<query_id, success>``. Only a
    successful result without rows counts as empty; a failed one always goes to documents.
    """
    if strategy not in ("try_unstructured", "try_hybrid", "none"):
        raise ValueError(f"unknown strategy {strategy}")
    tables = structured.select("query_id", F.col("success").alias("sql_ok"), "row_count")
    docs = documents.select("query_id", F.col("success").alias("docs_ok"))
    joined = (
        routes.filter(F.col("source") == "structured")
        .select("query_id")
        .join(tables, "query_id", "left")
        .join(docs, "query_id", "left")
    )
    sql_ok = F.coalesce("sql_ok", F.lit(False))
    docs_ok = F.coalesce("docs_ok", F.lit(False))
    empty = sql_ok & (F.coalesce("row_count", F.lit(-1)) == 0)
    asked_docs = ~sql_ok | (empty & F.lit(strategy != "none"))
    by_docs = F.when(F.lit(strategy == "try_hybrid") & sql_ok, "hybrid").otherwise("unstructured")
    answer = (
        F.when(asked_docs & docs_ok, by_docs).when(sql_ok, "structured").otherwise("none")
    )
    used = F.concat_ws(
        ",", F.when(sql_ok, "structured"), F.when(asked_docs & docs_ok, "unstructured")
    )
    reason = F.when(~sql_ok, "sql_failed").when(empty, "sql_empty").otherwise("answered")
    return joined.select(
        "query_id", answer.alias("answer_from"), used.alias("sources_used"), reason.alias("reason")
    )
