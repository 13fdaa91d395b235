"""Combine results of both sources and build prompts from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.fixed_values import SOURCES_PREAMBLE
from quaero.options import ContextOptions

TRUNCATED = "\n... [truncated]"


def combine_sources(structured: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks, sources used and total time per question.

    Both inputs are ``<query_id, success, content, error, ms>``; a source without a row for a
    question adds nothing.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("query_id", *[F.col(c).alias(f"{p}_{c}") for c in ("success", "content", "error", "ms")])

    def block(p: str, good: str, bad: str, failure: str) -> Column:
        return F.when(
            F.col(f"{p}_success"), F.concat(F.lit(f"=== {good} ===\n"), f"{p}_content")
        ).when(
            F.col(f"{p}_error").isNotNull(),
            F.concat(F.lit(f"=== {bad} ===\n({failure}: "), f"{p}_error", F.lit(")")),
        )

    joined = side(structured, "s").join(side(documents, "d"), "query_id", "full")
    context = F.concat_ws(
        "\n\n",
        block("s", "DATABASE RESULTS", "DATABASE", "Query failed"),
        block("d", "DOCUMENT CONTEXT", "DOCUMENTS", "Retrieval failed"),
    )
    nothing = F.lit("Unable to retrieve information from any source.")
    return joined.select(
        "query_id",
        F.when(context == "", nothing).otherwise(context).alias("context"),
        F.concat_ws(
            ",", F.when(F.col("s_success"), "structured"), F.when(F.col("d_success"), "unstructured")
        ).alias("sources_used"),
        (F.coalesce("s_ms", F.lit(0.0)) + F.coalesce("d_ms", F.lit(0.0))).alias("total_ms"),
        sources_summary(F.col("s_success"), F.col("d_success")).alias("summary"),
    )


def sources_summary(structured: Column, documents: Column) -> Column:
    """``[OK] a, [FAIL] b`` over the sources that were asked."""

    def part(success: Column, name: str) -> Column:
        return F.when(success, f"[OK] {name}").when(~success, f"[FAIL] {name}")

    parts = F.concat_ws(", ", part(structured, "structured"), part(documents, "unstructured"))
    return F.when(parts == "", "No sources queried").otherwise(F.concat(F.lit("Sources: "), parts))


def truncate_context(
    database: Column, documents: Column, other: Column, options: ContextOptions = ContextOptions()
) -> Column:
    """Blocks joined within the character limit.

    Database first (up to its share), then whole paragraphs of the documents, then the other
    block if it fits; documents do not count against the room of the other block.
    """
    sep = options.separator
    database, documents, other = (F.coalesce(c, F.lit("")) for c in (database, documents, other))

    def joined(*blocks: Column) -> Column:
        return F.concat_ws(sep, *[F.nullif(b, F.lit("")) for b in blocks])

    share = int(options.max_chars * options.database_share)
    cut_database = F.when(
        F.length(database) > share, F.concat(F.substring(database, 1, share), F.lit(TRUNCATED))
    ).otherwise(database)
    room = options.max_chars - F.least(F.length(database), F.lit(share)) - options.margin
    paragraphs = F.split(documents, re.escape(sep))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(s, paragraph):
        size = s["used"] + F.length(paragraph) + len(sep)
        fits = s["open"] & (size <= room)
        return F.struct(
            (s["n"] + fits.cast("int")).alias("n"),
            F.when(fits, size).otherwise(s["used"]).alias("used"),
            fits.alias("open"),
        )

    kept = F.aggregate(paragraphs, start, step, lambda s: s["n"])
    prefix = F.regexp_replace(F.concat_ws(sep, F.slice(paragraphs, F.lit(1), kept)), r"\s+$", "")
    cut_documents = F.when(
        (documents != "") & (room > options.min_document_room),
        F.when(F.length(documents) <= room, documents).otherwise(F.concat(prefix, F.lit(TRUNCATED))),
    ).otherwise("")
    cut_other = F.when(
        (room > options.min_other_room) & (F.length(other) <= room), other
    ).otherwise("")
    whole = joined(database, documents, other)
    return F.when(F.length(whole) <= options.max_chars, whole).otherwise(
        joined(cut_database, cut_documents, cut_other)
    )


def template_variables(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))


def has_variables(template: Column, *required: str) -> Column:
    """True if all required variables occur."""
    wanted = F.array(*[F.lit(r) for r in required])
    return F.size(F.array_except(wanted, template_variables(template))) == 0


def fill_template(template: Column, **values: Column) -> Column:
    """Replace ``{name}`` by the given columns; null values become empty.

    The template is filled once: a value that itself holds ``{name}`` stays as it is.
    """
    between = F.split(template, r"\{\w+\}")
    pairs = [x for name, value in values.items() for x in (F.lit(name), F.coalesce(value, F.lit("")))]
    known = F.create_map(*pairs)

    def piece(text: Column, name: Column) -> Column:
        unknown = F.concat(F.lit("{"), name, F.lit("}"))
        value = F.coalesce(F.try_element_at(known, name), unknown)
        return F.concat(text, F.when(name.isNull(), "").otherwise(value))

    return F.concat_ws("", F.zip_with(between, template_variables(template), piece))


def wrap_source(content: Column) -> Column:
    return F.concat(F.lit("<BEGIN SOURCE>\n"), content, F.lit("\n</END SOURCE>"))


def wrap_sources(hits: DataFrame) -> DataFrame:
    """One text per question with all its ranked contents, best first.

    ``hits<query_id, rank, content>`` is a top-k list: its k bounds the text of a question.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", wrap_source(F.col("content")).alias("block"))))
    blocks = F.concat_ws("\n\n", F.transform(listed, lambda h: h["block"]))
    return hits.groupBy("query_id").agg(
        F.concat(F.lit(SOURCES_PREAMBLE + "\n\n"), blocks).alias("text")
    )
