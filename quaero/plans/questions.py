"""Question preprocessing: normal forms, tokens and known metadata values.

Questions about parts are built from every ``part`` row; known values are the part names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.fixed_values import STOPWORDS
from quaero.functions import text as tx
from quaero.operators import prefilter as pf
from quaero.plans.lexical_search import LANGUAGE, LANGUAGE_WORDS
from quaero.plans.registry import query

NORMAL = "strip_accents(lower(text))"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w))"


@query("normalise_text", f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normalise_text(t):
    return t.documents.select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query(
    "significant_tokens",
    f"SELECT doc_id, array_to_string({tokens_sql(NORMAL)}, ' ') AS words FROM documents",
)
def significant_tokens(t):
    words = tx.significant_tokens(tx.normalise(F.col("text")))
    return t.documents.select("doc_id", F.concat_ws(" ", words).alias("words"))


@query(
    "expand_numerals",
    """WITH twins AS (SELECT MAP(['i','ii','iii','iv','v','vi','vii','viii','ix','x','1','2','3','4','5','6','7','8','9','10'],
  ['1','2','3','4','5','6','7','8','9','10','i','ii','iii','iv','v','vi','vii','viii','ix','x']) AS m),
words AS (SELECT p_partkey, ['volume', CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE (p_size % 12)::VARCHAR END, CASE WHEN p_type = 'PROMO' THEN 'iv' ELSE 'x' END] AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(w, list_filter(list_transform(w, lambda x: m[x]), lambda x: x IS NOT NULL)))), ' ') AS words
FROM words, twins""",
)
def expand_numerals(t):
    number = F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(F.col("p_size") % 12)
    words = F.array(
        F.lit("volume"), number.cast("string"), F.when(F.col("p_type") == "PROMO", "iv").otherwise("x")
    )
    twins = tx.expand_numerals(words)
    return t.part.select("p_partkey", F.concat_ws(" ", F.array_sort(twins)).alias("words"))


QUESTIONS = """
asked AS (SELECT p_partkey AS query_id, CASE p_type
  WHEN 'STANDARD' THEN '¿Qué precio tiene el ' || p_name || '?'
  WHEN 'ECONOMY' THEN 'Cuántos ' || p_name || 's hay'
  WHEN 'MEDIUM' THEN 'un ' || split_part(p_name, ' ', 2) || ' de color ' || split_part(p_name, ' ', 1)
  WHEN 'PROMO' THEN upper(p_name) || ' / ' || p_brand
  WHEN 'LARGE' THEN 'precio del ' || replace(p_name, 'i', 'y') || ' hoy'
  ELSE 'otra cosa ' || p_size END AS text FROM part),
vals AS (SELECT strip_accents(lower(p_name)) AS norm, max(p_name) AS value FROM part GROUP BY 1),
normal AS (SELECT query_id, strip_accents(lower(text)) AS n FROM asked)"""
SUBSTRING = r"""
located AS (SELECT query_id, value, norm, n, instr(n, norm) AS pos FROM normal, vals WHERE instr(n, norm) > 0),
sub AS (SELECT query_id, value, 1.5::DOUBLE + length(norm) AS score FROM located
  WHERE NOT regexp_matches(substr(n, pos + length(norm), 1), '[\p{L}\p{N}]'))"""
OVERLAP = f"""
val_words AS (SELECT value, unnest({tokens_sql("norm")}) AS word, len({tokens_sql("norm")}) AS n_words FROM vals),
q_words AS (SELECT DISTINCT query_id, unnest({tokens_sql("n")}) AS word FROM normal),
tok AS (SELECT query_id, value, count(*)::DOUBLE / n_words AS score FROM q_words JOIN val_words USING (word) WHERE n_words >= 2
  GROUP BY query_id, value, n_words HAVING count(*) >= 2)"""


def part_questions(t):
    name, kind = F.col("p_name"), F.col("p_type")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    text = (
        F.when(kind == "STANDARD", F.concat(F.lit("¿Qué precio tiene el "), name, F.lit("?")))
        .when(kind == "ECONOMY", F.concat(F.lit("Cuántos "), name, F.lit("s hay")))
        .when(kind == "MEDIUM", F.concat(F.lit("un "), second, F.lit(" de color "), first))
        .when(kind == "PROMO", F.concat(F.upper(name), F.lit(" / "), "p_brand"))
        .when(kind == "LARGE", F.concat(F.lit("precio del "), F.translate(name, "i", "y"), F.lit(" hoy")))
        .otherwise(F.concat(F.lit("otra cosa "), F.col("p_size").cast("string")))
    )
    return t.part.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


def part_names(t):
    return t.part.select(F.col("p_name").alias("value")).distinct()


@query("match_substring", f"WITH {QUESTIONS}, {SUBSTRING} SELECT query_id, value, score FROM sub")
def match_substring(t):
    return pf.match_substring(part_questions(t), part_names(t))


@query("match_token_overlap", f"WITH {QUESTIONS}, {OVERLAP} SELECT query_id, value, round(score, 6) AS score FROM tok")
def match_token_overlap(t):
    found = pf.match_token_overlap(part_questions(t), part_names(t))
    return found.withColumn("score", F.round("score", 6))


@query("match_fuzzy_window")
def match_fuzzy_window(t):
    """Fuzzy tier; equal question texts are compared once and joined back."""
    asked = part_questions(t)
    unique = asked.groupBy("text").agg(F.min("query_id").alias("query_id"))
    found = pf.match_fuzzy_window(unique, part_names(t)).withColumn("score", F.round("score", 6))
    return unique.join(found, "query_id").select("text", "value", "score")


@query(
    "detect_metadata_value_exact",
    f"""WITH {QUESTIONS}, {SUBSTRING}, {OVERLAP},
tiers AS (SELECT query_id, value, score FROM sub UNION ALL SELECT query_id, value, score FROM tok),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, value) AS r FROM tiers)
SELECT query_id, value AS matched_value, round(least(score, 1), 6) AS similarity FROM best WHERE r = 1 AND score >= 0.65""",
)
def detect_metadata_value_exact(t):
    return pf.detect_metadata_value(part_questions(t), part_names(t), fuzzy=False)


@query("detect_metadata_value")
def detect_metadata_value(t):
    asked = part_questions(t)
    unique = asked.groupBy("text").agg(F.min("query_id").alias("query_id"))
    found = pf.detect_metadata_value(unique, part_names(t))
    return unique.join(found, "query_id").select("text", "matched_value", "similarity")


@query(
    "detect_boost_value",
    f"SELECT doc_id, {LANGUAGE} AS boost_value FROM (SELECT doc_id, {NORMAL} AS n FROM documents)",
)
def detect_boost_value(t):
    return t.documents.select(
        "doc_id", pf.detect_boost_value(F.col("text"), LANGUAGE_WORDS).alias("boost_value")
    )
