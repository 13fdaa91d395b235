"""Columns that judge and clean SQL texts held in a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.fixed_values import FORBIDDEN_PATTERNS, INJECTION_PATTERNS, RETRYABLE_ERRORS

_ANY_CASE = "(?i)"
_TABLE_AFTER = r"(?i)(?:FROM|JOIN|INTO)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
# one statement: anything but quotes and semicolons, or whole quoted strings
# (possessive, so that the length of a statement costs no stack)
_STATEMENT = r"(?:[^';]++|'[^']*+(?:'|$))++"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise_sql(sql: Column) -> Column:
    """Trimmed, runs of white space as one blank, no trailing semicolons."""
    return F.regexp_replace(F.regexp_replace(_strip(sql), r"\s+", " "), ";+$", "")


def _found(sql: Column, patterns: Sequence[str], before: str, after: str) -> list[Column]:
    return [
        F.when(F.regexp_like(sql, F.lit(_ANY_CASE + p)), F.lit(before + p + after)) for p in patterns
    ]


def sql_errors(
    sql: Column,
    tables: Sequence[str] = (),
    select_only: bool = True,
    injection: Sequence[str] = INJECTION_PATTERNS,
    forbidden: Sequence[str] = FORBIDDEN_PATTERNS,
) -> Column:
    """Messages for everything that makes a normalised SQL text invalid."""
    checks = []
    if select_only:
        is_select = F.regexp_like(sql, F.lit(r"(?i)^\s*SELECT\b"))
        checks.append(F.when(~is_select, F.lit("Only SELECT statements are allowed")))
    checks += _found(sql, injection, "Potential SQL injection detected: pattern '", "'")
    checks += _found(sql, forbidden, "Forbidden pattern detected: '", "'")
    errors = F.array_compact(F.array(*checks))
    if tables:
        allowed = [t.upper() for t in tables]
        used = F.regexp_extract_all(sql, F.lit(_TABLE_AFTER), F.lit(1))
        strange = F.filter(used, lambda t: ~F.upper(t).isin(*allowed))
        errors = F.concat(
            errors,
            F.transform(
                strange, lambda t: F.concat(F.lit("Table '"), t, F.lit("' is not in allowed list"))
            ),
        )
    return F.when(_strip(sql) == "", F.array(F.lit("Empty query"))).otherwise(errors)


def sql_warnings(sql: Column, max_joins: int = 3, max_nested: int = 2) -> Column:
    """Messages about joins, nested selects and wildcards; they do not make a text invalid."""
    joins = F.regexp_count(sql, F.lit(r"(?i)\bJOIN\b"))
    nested = F.regexp_count(F.upper(sql), F.lit("SELECT")) - 1
    return F.array_compact(
        F.array(
            F.when(
                joins > max_joins,
                F.concat(F.lit("Complex query with "), joins.cast("string"), F.lit(" JOINs")),
            ),
            F.when(
                nested > max_nested,
                F.concat(F.lit("Query has "), nested.cast("string"), F.lit(" subqueries")),
            ),
            F.when(
                F.contains(F.upper(sql), F.lit("SELECT *")),
                F.lit("SELECT * may return excessive data"),
            ),
        )
    )


def clean_sql_response(response: Column) -> Column:
    """First SELECT statement of a model response: fences, prefixes and further statements go."""
    tagged = F.split(response, "```sql")
    plain = F.split(response, "```")
    inside = (
        F.when(
            F.contains(F.lower(response), F.lit("```sql")),
            F.element_at(F.split(F.element_at(tagged, -1), "```"), 1),
        )
        .when(F.contains(response, F.lit("```")), F.element_at(plain, 2))
        .otherwise(response)
    )
    body = inside
    for prefix in ("SQL:", "Query:"):
        body = F.regexp_replace(body, f"(?i)^{prefix}\\s*", "")
    start = F.instr(F.upper(body), F.lit("SELECT"))
    body = _strip(F.when(start > 0, F.substring(body, start, F.length(body))).otherwise(body))
    statements = F.transform(
        F.regexp_extract_all(body, F.lit(_STATEMENT), F.lit(0)), lambda s: _strip(s)
    )
    selects = F.filter(statements, lambda s: F.startswith(F.upper(s), F.lit("SELECT")))
    first = F.try_element_at(selects, F.lit(1))
    return F.when(F.contains(body, F.lit(";")), F.coalesce(first, body)).otherwise(body)


def strip_comments(sql: Column) -> tuple[Column, Column]:
    """SQL without trailing semicolon and comments, and the list of what was removed."""
    ends = F.regexp_like(sql, F.lit(r";\s*$"))
    shorter = F.when(ends, F.regexp_replace(sql, r"[;\s]+$", "")).otherwise(sql)
    lines = F.contains(shorter, F.lit("--"))
    no_lines = F.regexp_replace(shorter, "(?m)--.*$", "")
    blocks = F.contains(no_lines, F.lit("/*"))
    clean = _strip(F.regexp_replace(no_lines, r"(?s)/\*.*?\*/", ""))
    changes = F.array_compact(
        F.array(
            F.when(ends, F.lit("Removed trailing semicolon")),
            F.when(lines, F.lit("Removed line comments")),
            F.when(blocks, F.lit("Removed block comments")),
        )
    )
    return clean, changes


def is_retryable(error: Column, words: Sequence[str] = RETRYABLE_ERRORS) -> Column:
    """True for errors that may pass when tried again."""
    lowered = F.lower(F.coalesce(error, F.lit("")))
    test = F.lit(False)
    for word in words:
        test = test | F.contains(lowered, F.lit(word))
    return test


def short_error(error: Column, limit: int = 200) -> Column:
    """First line of an error, cut to the limit."""
    line = F.substring_index(error, "\n", 1)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)
