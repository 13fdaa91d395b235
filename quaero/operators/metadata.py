"""Metadata of chunks: from file names, lookup tables and headings; what is shown to whom."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.operators.sizing import lookup_join


def filename_metadata(file_name: Column, patterns: Sequence[str]) -> dict[str, Column]:
    """One column per named group; later patterns win, missing groups are null."""
    found: dict[str, list[Column]] = {}
    for pattern in patterns:
        groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groupindex
        java = pattern.replace("(?P<", "(?<")
        for name, number in groups.items():
            value = F.nullif(F.regexp_extract(file_name, java, number), F.lit(""))
            found.setdefault(name, []).append(value)
    return {name: F.coalesce(*reversed(values)) for name, values in found.items()}


def enrich_from_lookup(
    chunks: DataFrame, lookup: DataFrame | None, source: str, target: str
) -> DataFrame:
    """Add ``target`` from ``lookup<key, value, position>``, compared as text.

    Of doubled keys the one with the last position counts; empty values do not apply; without a
    table nothing changes.
    """
    if lookup is None:
        return chunks
    single = (
        lookup.groupBy(F.col("key").cast("string").alias(source))
        .agg(F.max_by(F.col("value").cast("string"), "position").alias(target))
        .filter(F.col(target) != "")
    )
    return lookup_join(chunks.withColumn(source, F.col(source).cast("string")), single, [source], "left")


def source_context(file_name: Column, heading: Column) -> Column:
    """``Fuente: f | Sección: h`` from the parts there are, else null."""
    parts = F.concat_ws(
        " | ",
        F.when(F.coalesce(file_name, F.lit("")) != "", F.concat(F.lit("Fuente: "), file_name)),
        F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("Sección: "), heading)),
    )
    return F.nullif(parts, F.lit(""))


def visible_text(content: Column, shown: Mapping[str, Column]) -> Column:
    """Content below the ``name: value`` lines of the shown fields that have a value."""
    lines = [
        F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
        for name, value in shown.items()
    ]
    return F.concat_ws("\n", *lines, content)


def distinct_values(chunks: DataFrame, field: Column) -> DataFrame:
    """Distinct non-empty values of a field, sorted."""
    return chunks.select(field.alias("value")).filter("value <> ''").distinct().orderBy("value")


def missing_audit(chunks: DataFrame, field: Column) -> DataFrame:
    """How many chunks lack the field, of how many."""
    return chunks.agg(
        F.count_if(F.coalesce(field, F.lit("")) == "").alias("missing"), F.count("*").alias("total")
    )


def sanitize_file_name(name: Column, limit: int = 100) -> Column:
    """Lower case with ``_`` for anything but letters, digits and dots; the base is cut to fit.

    A name without a dot is its own extension.
    """
    extension = F.regexp_extract(name, r"[^.]*$", 0)
    valid = F.lower(F.regexp_replace(name, "[^A-Za-z0-9.]", "_"))
    base = F.regexp_replace(valid, r"\.[^.]*$", "")
    room = F.greatest(limit - F.length(extension) - 1, F.lit(0))
    return F.concat(F.substring(base, F.lit(1), room), F.lit("."), extension)
