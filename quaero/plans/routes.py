"""Question routing over ``conversations`` and ``documents``, and its evaluation over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.functions.text import normalise_literal
from quaero.operators import behaviour as bh
from quaero.operators import corrective as co
from quaero.operators import retrieval_metrics as rm
from quaero.operators import routing as rt
from quaero.options import RouterOptions
from quaero.plans import dense_search as ds
from quaero.plans.registry import query

OPTIONS = RouterOptions(
    structured_keywords=("étion", "the and", "ention", "que la"),
    unstructured_keywords=("Keit", "ing the", "lich", "els"),
)

# -- questions with source tags ---------------------------------------------------------------

TAGGED = """
tagged AS (SELECT conv_id * 100 + turn AS query_id, CASE turn WHEN 0 THEN text || ' [no   Estructurado]  ahora'
  WHEN 1 THEN 'HÍBRIDO ' || text || ' estructurado' WHEN 2 THEN 'Estructurado  ' || text
  WHEN 3 THEN 'desestructurado ' || text ELSE text END AS text FROM conversations)"""
TAG = r"(?i)\b(NO\s+ESTRUCTURADO|ESTRUCTURADO|H[ÍI]BRIDO)\b"
OVERRIDE = rf"""
tags AS (SELECT query_id, text, regexp_extract(text, '{TAG}', 1) AS tag FROM tagged),
overridden AS (SELECT query_id, CASE WHEN strip_accents(lower(tag)) LIKE '%hibrido%' THEN 'hybrid'
  WHEN strip_accents(lower(tag)) LIKE '%no%' THEN 'unstructured' ELSE 'structured' END AS source, 1.0::DOUBLE AS confidence,
  'manual_override' AS method, 'Manual override tag ''' || tag || ''' detected' AS reasoning,
  regexp_replace(regexp_replace(regexp_replace(text, '{TAG}', '', 'g'), '^\s+|\s+$', '', 'g'), '\s{{2,}}', ' ', 'g') AS clean_query
  FROM tags WHERE tag <> '')"""


def hits_sql(words, column="n"):
    return " + ".join(f"contains({column}, '{normalise_literal(w)}')::INT" for w in words)


KEYWORDS = f"""
normal AS (SELECT query_id, strip_accents(lower(text)) AS n FROM asked),
sides AS (SELECT query_id, {hits_sql(OPTIONS.structured_keywords)} AS s, {hits_sql(OPTIONS.unstructured_keywords)} AS u FROM normal),
ruled AS (SELECT query_id, CASE WHEN s::DOUBLE / (s + u) >= 0.8 THEN 'structured' ELSE 'unstructured' END AS source,
  greatest(s, u)::DOUBLE / (s + u) AS confidence, 'rules' AS method,
  'Keyword routing: ' || s || ' structured hits, ' || u || ' unstructured hits' AS reasoning
  FROM sides WHERE s + u > 0 AND greatest(s, u)::DOUBLE / (s + u) >= 0.8)"""


def tagged(t):
    text, turn = F.col("text"), F.col("turn")
    return t.conversations.select(
        (F.col("conv_id") * 100 + turn).alias("query_id"),
        F.when(turn == 0, F.concat(text, F.lit(" [no   Estructurado]  ahora")))
        .when(turn == 1, F.concat(F.lit("HÍBRIDO "), text, F.lit(" estructurado")))
        .when(turn == 2, F.concat(F.lit("Estructurado  "), text))
        .when(turn == 3, F.concat(F.lit("desestructurado "), text))
        .otherwise(text)
        .alias("text"),
    )


@query(
    "route_override",
    f"WITH {TAGGED}, {OVERRIDE} SELECT query_id, source, confidence, method, reasoning, clean_query FROM overridden",
)
def route_override(t):
    routed = (
        tagged(t)
        .withColumn("tag", rt.override_tag(F.col("text")))
        .withColumn("route", rt.override(F.col("text"), F.col("tag")))
    )
    return routed.filter("route IS NOT NULL").select("query_id", "route.*")


@query(
    "route_keywords",
    f"""WITH asked AS (SELECT doc_id AS query_id, text FROM documents), {KEYWORDS}
SELECT query_id, s::BIGINT AS structured_hits, u::BIGINT AS unstructured_hits, source, confidence FROM sides LEFT JOIN ruled USING (query_id)""",
)
def route_keywords(t):
    structured, unstructured = rt.keyword_hits(F.col("text"), OPTIONS)
    counted = t.documents.select(
        F.col("doc_id").alias("query_id"),
        structured.cast("bigint").alias("structured_hits"),
        unstructured.cast("bigint").alias("unstructured_hits"),
    )
    route = rt.by_keywords(F.col("structured_hits"), F.col("unstructured_hits"), OPTIONS)
    return counted.select("*", route["source"].alias("source"), route["confidence"].alias("confidence"))


ANSWERS = """
answers AS (SELECT event_id AS query_id, CASE event_type WHEN 'view' THEN 'Structured 0.' || substr(props, 7, 2)
  WHEN 'click' THEN 'I would say UNSTRUCTURED (0.' || event_id || ')' WHEN 'purchase' THEN 'hybrid 1.0'
  WHEN 'signup' THEN 'structured' ELSE 'no idea 0.4' END AS response FROM events)"""
PARSED = r"""
parsed AS (SELECT query_id, CASE WHEN upper(response) LIKE '%HYBRID%' THEN 'hybrid' WHEN upper(response) LIKE '%UNSTRUCTURED%' THEN 'unstructured'
  WHEN upper(response) LIKE '%STRUCTURED%' THEN 'structured' END AS source,
  CASE WHEN upper(response) NOT LIKE '%HYBRID%' AND upper(response) NOT LIKE '%STRUCTURED%' THEN 0.0::DOUBLE ELSE
  coalesce(try_cast(nullif(regexp_extract(response, '(0\.\d+)', 1), '') AS DOUBLE), 0.8) END AS confidence FROM answers)"""


def answers(t):
    kind = F.col("event_type")
    response = (
        F.when(kind == "view", F.concat(F.lit("Structured 0."), F.substring("props", 7, 2)))
        .when(kind == "click", F.concat(F.lit("I would say UNSTRUCTURED (0."), "event_id", F.lit(")")))
        .when(kind == "purchase", "hybrid 1.0")
        .when(kind == "signup", "structured")
        .otherwise("no idea 0.4")
    )
    return t.events.select(F.col("event_id").alias("query_id"), response.alias("response"))


@query("parse_route_responses", f"WITH {ANSWERS}, {PARSED} SELECT * FROM parsed")
def parse_route_responses(t):
    source, confidence = rt.parse_response(F.col("response"))
    return answers(t).select(
        "query_id", source.alias("source"), confidence.cast("double").alias("confidence")
    )


@query(
    "route_low_confidence_to_hybrid",
    f"""WITH {ANSWERS}, {PARSED} SELECT query_id, CASE WHEN confidence < 0.7 THEN 'hybrid' ELSE source END AS source, confidence
  FROM parsed WHERE source IS NOT NULL""",
)
def route_low_confidence_to_hybrid(t):
    routed = answers(t).withColumn("route", rt.by_response(F.col("response"), OPTIONS))
    return routed.filter("route IS NOT NULL").select(
        "query_id", F.col("route.source").alias("source"), F.col("route.confidence").alias("confidence")
    )


ROUTED = f"""
asked AS (SELECT * FROM tagged WHERE query_id NOT IN (SELECT query_id FROM overridden)), {KEYWORDS},
open_questions AS (SELECT query_id, text FROM asked WHERE query_id NOT IN (SELECT query_id FROM ruled)),
answers AS (SELECT conv_id * 100 + turn AS query_id, CASE role WHEN 'user' THEN 'STRUCTURED 0.' || length(text)
  WHEN 'assistant' THEN 'UNSTRUCTURED 0.9' END AS response FROM conversations), {PARSED},
routed AS (SELECT query_id, source, confidence, method, reasoning, clean_query FROM overridden
  UNION ALL SELECT query_id, source, confidence, method, reasoning, NULL FROM ruled
  UNION ALL SELECT query_id, CASE WHEN p.source IS NULL THEN 'unstructured' WHEN p.confidence < 0.7 THEN 'hybrid' ELSE p.source END,
    CASE WHEN p.source IS NULL THEN 1.0 ELSE p.confidence END, CASE WHEN p.source IS NULL THEN 'default' ELSE 'llm' END,
    CASE WHEN p.source IS NULL THEN 'LLM unavailable, using default' ELSE 'LLM classified query as ' || CASE WHEN p.confidence < 0.7 THEN 'hybrid' ELSE p.source END END, NULL
  FROM open_questions LEFT JOIN parsed p USING (query_id))"""


def routed(t):
    response = F.when(
        F.col("role") == "user", F.concat(F.lit("STRUCTURED 0."), F.length("text"))
    ).when(F.col("role") == "assistant", "UNSTRUCTURED 0.9")
    recorded = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), response.alias("response")
    )
    return rt.route_questions(tagged(t), OPTIONS, recorded)


@query("route_questions", f"WITH {TAGGED}, {OVERRIDE}, {ROUTED} SELECT * FROM routed")
def route_questions(t):
    return routed(t)


@query(
    "route_distribution",
    f"WITH {TAGGED}, {OVERRIDE}, {ROUTED} SELECT source, method, count(*) AS n FROM routed GROUP BY ALL",
)
def route_distribution(t):
    return rt.distribution(routed(t))


def fallback_sql(strategy: str) -> str:
    docs = "c_acctbal > 0"
    ok = "c_nationkey <> 3"
    empty = f"({ok} AND n = 0)"
    asked = f"(NOT {ok}" + (f" OR {empty})" if strategy != "none" else ")")
    by_docs = f"CASE WHEN {ok} THEN 'hybrid' ELSE 'unstructured' END" if strategy == "try_hybrid" else "'unstructured'"
    return f"""SELECT '{strategy}' AS strategy, c_custkey AS query_id,
  CASE WHEN {asked} AND {docs} THEN {by_docs} WHEN {ok} THEN 'structured' ELSE 'none' END AS answer_from,
  concat_ws(',', CASE WHEN {ok} THEN 'structured' END, CASE WHEN {asked} AND {docs} THEN 'unstructured' END) AS sources_used,
  CASE WHEN NOT {ok} THEN 'sql_failed' WHEN {empty} THEN 'sql_empty' ELSE 'answered' END AS reason FROM results"""


@query(
    "empty_result_fallback",
    """WITH results AS (SELECT c_custkey, c_acctbal, c_nationkey, count(o_orderkey) AS n FROM customer
  LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000 GROUP BY ALL) """
    + " UNION ALL ".join(fallback_sql(s) for s in ("none", "try_unstructured", "try_hybrid")),
)
def empty_result_fallback(t):
    """Each customer asks for large finished orders; nation 3 fails, poor customers have no documents."""
    counts = (
        t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))
        .groupBy(F.col("o_custkey").alias("query_id"))
        .agg(F.count("*").alias("row_count"))
    )
    asked = t.customer.withColumnRenamed("c_custkey", "query_id")
    routes = asked.select("query_id", F.lit("structured").alias("source"))
    tables = asked.join(counts, "query_id", "left").select(
        "query_id",
        (F.col("c_nationkey") != 3).alias("success"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )
    documents = asked.select("query_id", (F.col("c_acctbal") > 0).alias("success"))
    out = None
    for strategy in ("none", "try_unstructured", "try_hybrid"):
        got = rt.empty_result_fallback(routes, tables, documents, strategy)
        got = got.select(F.lit(strategy).alias("strategy"), "*")
        out = got if out is None else out.unionByName(got)
    return out


# -- evaluation over events -------------------------------------------------------------------

RESULTS = """
typed AS (SELECT event_id AS query_id, CASE event_type WHEN 'view' THEN 'rag' WHEN 'click' THEN 'sql' WHEN 'purchase' THEN 'hybrid'
  WHEN 'signup' THEN 'negative' ELSE 'other' END AS type, value / 500 AS confidence,
  CASE WHEN value < 60 THEN 'structured' WHEN value < 200 THEN 'unstructured' ELSE 'hybrid' END AS predicted,
  CASE WHEN dayofmonth(ts) < 15 THEN 'well_formed' ELSE 'adversarial' END AS partition FROM events),
results AS (SELECT *, CASE type WHEN 'sql' THEN 'structured' WHEN 'hybrid' THEN 'hybrid' ELSE 'unstructured' END AS truth FROM typed)"""


def results(t):
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("query_id"),
        F.when(kind == "view", "rag")
        .when(kind == "click", "sql")
        .when(kind == "purchase", "hybrid")
        .when(kind == "signup", "negative")
        .otherwise("other")
        .alias("type"),
        (F.col("value") / 500).alias("confidence"),
        F.when(F.col("value") < 60, "structured")
        .when(F.col("value") < 200, "unstructured")
        .otherwise("hybrid")
        .alias("predicted"),
        F.when(F.dayofmonth("ts") < 15, "well_formed").otherwise("adversarial").alias("partition"),
    ).withColumn("truth", bh.truth_from_type(F.col("type")))


@query("truth_from_type", f"WITH {RESULTS} SELECT query_id, type, truth FROM results")
def truth_from_type(t):
    return results(t).select("query_id", "type", "truth")


@query(
    "routing_accuracy",
    f"""WITH {RESULTS} SELECT CASE WHEN grouping(partition) = 1 THEN 'overall' ELSE partition END AS partition,
  count(*) FILTER (WHERE truth = predicted) AS correct, count(*) AS n_queries, round(avg((truth = predicted)::INT), 6) AS accuracy
  FROM results GROUP BY ROLLUP (partition)""",
)
def routing_accuracy(t):
    return bh.accuracy(results(t))


@query("confusion_matrix", f"WITH {RESULTS} SELECT truth, predicted, count(*) AS n FROM results GROUP BY ALL")
def confusion_matrix(t):
    return bh.confusion(results(t))


@query(
    "class_precision_recall_f1",
    f"""WITH {RESULTS}, classes AS (SELECT unnest(['hybrid', 'structured', 'unstructured']) AS class),
sums AS (SELECT class, count(*) FILTER (WHERE truth = class AND predicted = class) AS tp, count(*) FILTER (WHERE truth = class) AS support,
  count(*) FILTER (WHERE predicted = class) AS claimed FROM classes, results GROUP BY class),
pr AS (SELECT class, support, coalesce(tp::DOUBLE / nullif(claimed, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS r FROM sums)
SELECT class, round(p, 4) AS "precision", round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, support FROM pr""",
)
def class_precision_recall_f1(t):
    return bh.class_scores(bh.confusion(results(t)))


@query(
    "confidence_stats",
    f"""WITH {RESULTS}, r AS (SELECT *, truth = predicted AS correct FROM results)
SELECT CASE WHEN grouping(correct) = 1 THEN 'overall' WHEN correct THEN 'correct' ELSE 'incorrect' END AS "group",
  min(confidence) AS min, max(confidence) AS max, round(avg(confidence), 6) AS mean, count(*) AS n FROM r GROUP BY ROLLUP (correct)""",
)
def confidence_stats(t):
    return bh.confidence_stats(results(t))


@query(
    "confidence_histogram",
    f"""WITH {RESULTS} SELECT (floor(confidence * 10) + 1)::BIGINT AS bin, truth = predicted AS correct, count(*) AS n FROM results GROUP BY ALL""",
)
def confidence_histogram(t):
    return bh.confidence_histogram(results(t), 0.0, 1.0, 10)


@query(
    "routing_errors",
    f"""WITH {RESULTS} SELECT query_id, type, partition, truth, predicted, confidence FROM results WHERE truth <> predicted""",
)
def routing_errors(t):
    return bh.routing_errors(results(t)).select(
        "query_id", "type", "partition", "truth", "predicted", "confidence"
    )


ABSTAIN = """
replies AS (SELECT conv_id * 100 + turn AS query_id, role AS partition, length(text) % 2 = 0 AS expected,
  CASE WHEN turn = 1 THEN text || chr(10) || 'Lo siento: NO CUENTO con suficiente INFORMACIÓN.' WHEN turn = 2 AND length(text) % 3 = 0 THEN 'No tengo aquí información ni datos. Suficiente.'
  WHEN turn = 3 AND length(text) % 3 = 1 THEN 'no tengo información' || chr(10) || 'suficiente' WHEN turn = 4 THEN '' ELSE text END AS response FROM conversations),
judged_replies AS (SELECT *, coalesce(response, '') = '' OR regexp_matches(response, '(?i)(?:no cuento con suficiente información|información no encontrada|no dispongo de.*información|no tengo.*información.*suficiente|no es posible responder|no se encuentra.*en el contexto|fuera del alcance|no puedo responder|no hay información.*disponible)') AS actual FROM replies)"""


def replies(t):
    text, turn, size = F.col("text"), F.col("turn"), F.length("text")
    response = (
        F.when(turn == 1, F.concat(text, F.lit("\nLo siento: NO CUENTO con suficiente INFORMACIÓN.")))
        .when((turn == 2) & (size % 3 == 0), "No tengo aquí información ni datos. Suficiente.")
        .when((turn == 3) & (size % 3 == 1), "no tengo información\nsuficiente")
        .when(turn == 4, "")
        .otherwise(text)
    )
    return t.conversations.select(
        (F.col("conv_id") * 100 + turn).alias("query_id"),
        F.col("role").alias("partition"),
        (size % 2 == 0).alias("expected"),
        response.alias("response"),
    ).withColumn("actual", bh.is_abstention(F.col("response")))


@query("detect_abstention", f"WITH {ABSTAIN} SELECT query_id, actual FROM judged_replies")
def detect_abstention(t):
    return replies(t).select("query_id", "actual")


@query(
    "abstention_metrics",
    f"""WITH {ABSTAIN}, c AS (SELECT count(*) AS n_queries, count(*) FILTER (WHERE expected) AS expected_abstentions,
  count(*) FILTER (WHERE expected AND actual) AS true_positives, count(*) FILTER (WHERE expected AND NOT actual) AS false_negatives,
  count(*) FILTER (WHERE NOT expected AND actual) AS false_abstentions, count(*) FILTER (WHERE expected AND partition = 'user') AS adversarial_expected,
  count(*) FILTER (WHERE expected AND actual AND partition = 'user') AS adversarial_correct FROM judged_replies)
SELECT *, round(coalesce(true_positives::DOUBLE / nullif(expected_abstentions, 0), 0), 4) AS accuracy,
  round(coalesce(false_abstentions::DOUBLE / nullif(n_queries - expected_abstentions, 0), 0), 4) AS false_rate,
  round(coalesce(adversarial_correct::DOUBLE / nullif(adversarial_expected, 0), 0), 4) AS adversarial_accuracy FROM c""",
)
def abstention_metrics(t):
    return bh.abstention_metrics(replies(t), adversarial="user")


@query(
    "abstention_failures",
    f"""WITH {ABSTAIN} SELECT query_id, partition, CASE WHEN expected THEN 'missed_abstention' ELSE 'false_abstention' END AS kind
  FROM judged_replies WHERE expected <> actual""",
)
def abstention_failures(t):
    return bh.abstention_failures(replies(t)).select("query_id", "partition", "kind")


@query(
    "error_report",
    f"""WITH {ds.JUDGED}, {RESULTS}, {ABSTAIN}
SELECT 'failed_retrieval' AS section, 'dense' AS config, query_id::VARCHAR AS query_id,
  string_agg(file_name, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS detail
  FROM judged GROUP BY query_id HAVING count(*) FILTER (WHERE relevant AND rank <= 1) = 0
UNION ALL SELECT 'routing_errors', NULL, query_id::VARCHAR, truth || ' -> ' || predicted FROM results WHERE truth <> predicted
UNION ALL SELECT 'abstention_failures', NULL, query_id::VARCHAR, CASE WHEN expected THEN 'missed_abstention' ELSE 'false_abstention' END
  FROM judged_replies WHERE expected <> actual""",
)
def error_report(t):
    failed = rm.failures(ds.judged(t), 1, "file_name").select(
        F.lit("dense").alias("config"), "query_id", F.col("top_3").alias("detail")
    )
    wrong = bh.routing_errors(results(t)).select(
        "query_id", F.concat("truth", F.lit(" -> "), "predicted").alias("detail")
    )
    abstained = bh.abstention_failures(replies(t)).select("query_id", F.col("kind").alias("detail"))
    return bh.error_report(failed, wrong, abstained)


# -- model responses and grades ---------------------------------------------------------------

RESPONSES = """
responses AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN ' relevante.' WHEN quality = 1 AND toxic = 1 THEN 'No es relevante'
  WHEN toxic = 1 THEN 'no relevante' WHEN doc_id % 3 = 0 THEN 'muy útil' WHEN doc_id % 3 = 1 THEN 'sin relev' END AS response FROM labels)"""


def responses(t):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    response = (
        F.when(q & ~x, " relevante.")
        .when(q & x, "No es relevante")
        .when(x, "no relevante")
        .when(F.col("doc_id") % 3 == 0, "muy útil")
        .when(F.col("doc_id") % 3 == 1, "sin relev")
    )
    return t.labels.select("doc_id", response.alias("response"))


@query(
    "parse_grades",
    f"""WITH {RESPONSES} SELECT doc_id, CASE WHEN r LIKE '%IRRELEVANT%' OR r LIKE '%NO RELEVANTE%' THEN 'IRRELEVANT' WHEN r LIKE '%RELEVANT%' THEN 'RELEVANT'
  WHEN r LIKE '%AMBIGUO%' THEN 'AMBIGUOUS' WHEN regexp_matches(r, 'NO\\s*(ES\\s*)?RELEV|IRRELEV|SIN\\s*RELEV') THEN 'IRRELEVANT'
  WHEN regexp_matches(r, 'RELEV|ÚTIL|PERTINENTE|APLICABLE') THEN 'RELEVANT' ELSE 'AMBIGUOUS' END AS grade,
  coalesce(substr(r, 1, 100), 'Grading failed') AS reasoning FROM (SELECT doc_id, upper(trim(response)) AS r FROM responses)""",
)
def parse_grades(t):
    return responses(t).select(
        "doc_id",
        co.parse_grade(F.col("response")).alias("grade"),
        co.reasoning(F.col("response")).alias("reasoning"),
    )


@query(
    "clean_rewrites",
    """SELECT conv_id, turn, CASE WHEN length(bare) >= 5 THEN bare ELSE text END AS rewritten FROM
  (SELECT conv_id, turn, text, trim(trim(trim(trim(raw), '"'), '''')) AS bare FROM (SELECT conv_id, turn, text,
    CASE role WHEN 'user' THEN ' "' || text || '" ' WHEN 'system' THEN '"''ok''"' END AS raw FROM conversations))""",
)
def clean_rewrites(t):
    raw = F.when(F.col("role") == "user", F.concat(F.lit(' "'), "text", F.lit('" '))).when(
        F.col("role") == "system", "\"'ok'\""
    )
    return t.conversations.select(
        "conv_id", "turn", co.clean_rewrite(F.col("text"), raw).alias("rewritten")
    )


@query(
    "score_answers",
    """WITH a AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT lang, count(quality) AS scored, count(*) - count(quality) AS to_score, round(avg(quality), 6) AS faithfulness,
  round(avg(1 - toxic), 6) AS relevancy FROM a GROUP BY lang""",
)
def score_answers(t):
    """Cached judge scores by hash of id, language and text; the rest is counted as still to do."""
    parts = ["doc_id", "lang", "text"]
    cached = t.labels.join(t.documents, "doc_id").select(
        F.sha2(F.concat_ws("|", *parts), 256).alias("cache_key"),
        F.col("quality").alias("faithfulness"),
        (1 - F.col("toxic")).alias("relevancy"),
    )
    scored, missing = rm.score_answers(t.documents, cached, parts, ["faithfulness", "relevancy"])
    both = scored.select("lang", "faithfulness", "relevancy").unionByName(
        missing.select("lang"), allowMissingColumns=True
    )
    return both.groupBy("lang").agg(
        F.count("faithfulness").alias("scored"),
        F.count_if(F.col("faithfulness").isNull()).alias("to_score"),
        F.round(F.avg("faithfulness"), 6).alias("faithfulness"),
        F.round(F.avg("relevancy"), 6).alias("relevancy"),
    )
