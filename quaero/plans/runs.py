"""Trace analytics and data set statistics over ``events``, ``orders`` and the text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaero.functions.ranks import nearest_rank
from quaero.operators import behaviour as bh
from quaero.operators import dataset as st
from quaero.operators import latency as lt
from quaero.operators.sizing import materialise, one_row, shared_folder
from quaero.plans.registry import query
from quaero.sources import trace


def rank_sql(source: str, by: str, value: str, pct: str) -> str:
    """Nearest-rank element per group as SQL: place min(floor(n * p / 100), n - 1) of the order."""
    return f"""SELECT {by}, {pct}::DOUBLE AS pct, {value} AS value FROM (SELECT {by}, {value},
  row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source})
  WHERE i = least(floor(n * {pct} / 100.0), n - 1)"""


def ladder_sql(source: str, by: str, value: str, percents) -> str:
    return " UNION ALL ".join(rank_sql(source, by, value, str(p)) for p in percents)


def timings(t):
    return t.events.select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("event"),
        F.col("event_type").alias("phase"),
        F.col("value").alias("ms"),
    )


@query("nearest_rank_percentile", ladder_sql("events", "event_type", "value", (50, 95)))
def nearest_rank_percentile(t):
    return nearest_rank(t.events, ["event_type"], "value", (50, 95))


def stats_sql(source: str, by: str, value: str) -> str:
    return f"""stats AS (SELECT {by}, round(avg({value}), 9) AS mean, round(coalesce(stddev_samp({value}), 0), 9) AS stddev, count(*) AS n,
  round(min({value}), 9) AS min, round(max({value}), 9) AS max FROM {source} GROUP BY {by}),
medians AS ({rank_sql(source, by, value, "50")}), p95s AS ({rank_sql(source, by, value, "95")}),
full_stats AS (SELECT s.*, m.value AS median, p.value AS p95 FROM stats s JOIN medians m USING ({by}) JOIN p95s p USING ({by}))"""


PHASE_TIMES = """timings AS (SELECT CASE event_type WHEN 'view' THEN 'vector_ms' WHEN 'click' THEN 'bm25_ms' WHEN 'purchase' THEN 'total_ms'
  ELSE event_type END AS phase, value AS ms FROM events)"""


@query(
    "latency_by_phase",
    f"""WITH {PHASE_TIMES}, {stats_sql("timings", "phase", "ms")}
SELECT *, CASE phase WHEN 'vector_ms' THEN 2 WHEN 'bm25_ms' THEN 3 WHEN 'total_ms' THEN 11 ELSE 12 END::BIGINT AS position FROM full_stats""",
)
def latency_by_phase(t):
    names = {"view": "vector_ms", "click": "bm25_ms", "purchase": "total_ms"}
    return lt.by_phase(timings(t).replace(names, subset=["phase"]))


@query(
    "latency_by_type",
    f"""WITH typed AS (SELECT coalesce(c_mktsegment, '?') AS type, value AS ms FROM events
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id), {stats_sql("typed", "type", "ms")} SELECT * FROM full_stats""",
)
def latency_by_type(t):
    dataset = t.customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("type")
    )
    return lt.by_type(timings(t).select("query_id", "ms"), dataset)


def daily_phases(t):
    """Per user and day: a phases map with the summed ms per event type and their total."""
    per_type = t.events.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(
        F.sum("value").alias("ms")
    )
    # at most one entry per event type
    return per_type.groupBy("user_id", "day").agg(
        F.map_from_entries(
            F.concat(
                F.collect_list(F.struct("event_type", "ms")),
                F.array(F.struct(F.lit("total_ms").alias("event_type"), F.sum("ms").alias("ms"))),
            )
        ).alias("phases")
    )


@query(
    "phase_percentages",
    """SELECT event_type AS phase, round(100 * sum(value) / (SELECT sum(value) FROM events), 9) AS share_pct FROM events GROUP BY event_type""",
)
def phase_percentages(t):
    return lt.phase_percentages(daily_phases(t))


@query("percentile_ladder", ladder_sql("events", "event_type", "value", lt.LADDER))
def percentile_ladder(t):
    by = timings(t).withColumnRenamed("phase", "event_type")
    return lt.percentile_ladder(by, ["event_type"])


@query(
    "percentile_ladder_overall",
    ladder_sql("(SELECT 1 AS one, value FROM events)", "one", "value", lt.LADDER)
    .replace("SELECT one, ", "SELECT ", 1)
    .replace("UNION ALL SELECT one, ", "UNION ALL SELECT "),
)
def percentile_ladder_overall(t):
    return lt.percentile_ladder(timings(t), [])


VARIANCE = """
repeated AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 2),
per_query AS (SELECT user_id AS query_id, event_type AS phase, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stddev, count(*) AS n
  FROM events SEMI JOIN repeated USING (user_id) GROUP BY ALL)"""


@query(
    "run_variance",
    f"WITH {VARIANCE} SELECT query_id, phase, round(mean, 9) AS mean, round(stddev, 9) AS stddev, n FROM per_query",
)
def run_variance(t):
    return lt.run_variance(timings(t)).select(
        "query_id", "phase", F.round("mean", 9).alias("mean"), F.round("stddev", 9).alias("stddev"), "n"
    )


@query(
    "run_variance_of_means",
    f"""WITH {VARIANCE} SELECT phase, round(avg(mean), 9) AS mean, round(coalesce(stddev_samp(mean), 0), 9) AS stddev, count(*) AS n_queries
  FROM per_query GROUP BY phase""",
)
def run_variance_of_means(t):
    return lt.variance_of_means(lt.run_variance(timings(t)))


ENRICHED = """
enriched AS (SELECT event_id, user_id AS query_id, coalesce(CASE WHEN event_type = 'error' THEN event_type END, c_mktsegment, '?') AS type,
  coalesce(c_nationkey::VARCHAR, '?') AS partition, value AS total_ms, CASE WHEN event_type = 'error' THEN props END AS error, event_type AS source
  FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id)"""


def enriched(t):
    failed = F.col("event_type") == "error"
    events = t.events.select(
        "event_id",
        F.col("user_id").alias("query_id"),
        F.when(failed, F.col("event_type")).alias("type"),
        F.col("value").alias("total_ms"),
        F.when(failed, F.col("props")).alias("error"),
        F.col("event_type").alias("source"),
    )
    dataset = t.customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("query_id"),
        F.col("c_mktsegment").alias("type"),
        F.col("c_nationkey").alias("partition"),
    )
    return lt.enrich_events(events, dataset, ["type", "partition"])


@query("enrich_events", f"WITH {ENRICHED} SELECT event_id, query_id, type, partition FROM enriched")
def enrich_events(t):
    return enriched(t).select("event_id", "query_id", "type", "partition")


@query("filter_events", f"WITH {ENRICHED} SELECT event_id, query_id, type FROM enriched WHERE type = 'BUILDING'")
def filter_events(t):
    return lt.filter_events(enriched(t), query_id=None, type="BUILDING").select("event_id", "query_id", "type")


@query(
    "run_summary",
    f"""WITH {ENRICHED} SELECT event_id, query_id || '  ' || source || '  ' || round(total_ms, 1)::DECIMAL(18, 1)::VARCHAR || '  ' ||
  CASE WHEN error IS NOT NULL THEN 'ERROR' ELSE 'ok' END AS line FROM enriched""",
)
def run_summary(t):
    return lt.run_lines(enriched(t)).select("event_id", "line")


@query(
    "error_and_retry_rates",
    """SELECT ts::DATE AS day, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS error_rate,
  sum((value > 100)::INT + (value > 300)::INT)::BIGINT AS retries FROM events GROUP BY ALL""",
)
def error_and_retry_rates(t):
    attempts = 1 + (F.col("value") > 100).cast("bigint") + (F.col("value") > 300).cast("bigint")
    events = t.events.select(
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        attempts.alias("attempts"),
    )
    return lt.error_and_retry_rates(events, ["day"])


# -- corrective and SQL records ---------------------------------------------------------------


def key_of(props):
    return F.get_json_object(props, "$.k").cast("int")


@query(
    "corrective_metrics",
    """WITH r AS (SELECT (props->>'$.k')::INT AS k FROM events),
c AS (SELECT count(*) AS n_queries, round(avg(k / 100), 4) AS mean_relevance_ratio, count(*) FILTER (WHERE k > 50) AS rewrite_count,
  sum(k % 5 + 1)::BIGINT AS chunks_before, sum(CASE WHEN k % 5 > 1 THEN 2 ELSE 0 END + (k % 2))::BIGINT AS chunks_after FROM r)
SELECT *, round(rewrite_count / n_queries, 4) AS rewrite_rate, round(1 - chunks_after / chunks_before, 4) AS filtering_rate FROM c""",
)
def corrective_metrics(t):
    k = F.col("k")
    record = F.struct(
        (k / 100).alias("relevance_ratio"),
        (k > 50).alias("rewrite_triggered"),
        F.transform(F.sequence(F.lit(1), k % 5 + 1), lambda i: F.col("value") / i).alias(
            "grading_per_chunk_ms"
        ),
        F.when(k % 5 > 1, 2).otherwise(0).alias("relevant_count"),
        (k % 2).alias("ambiguous_count"),
    )
    keyed = t.events.select("value", key_of("props").alias("k"))
    return bh.corrective_metrics(keyed.select(record.alias("crag")))


def sql_traces(t):
    """Per order one record: as many attempts as the priority says, all but the last failed."""
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    attempts = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            i.alias("attempt"),
            (F.col("o_totalprice") / i).alias("sql_generation_ms"),
            i.cast("double").alias("validation_ms"),
            (F.col("o_totalprice") / 100).alias("execution_ms"),
            F.when(i < n, F.col("o_orderstatus")).alias("error_type"),
        ),
    )
    record = F.struct(
        attempts.alias("attempts"),
        n.alias("total_attempts"),
        F.col("o_totalprice").alias("total_ms"),
        (F.col("o_orderstatus") != "P").alias("success"),
        (n > 3).alias("query_relaxed"),
    )
    return t.orders.select(F.col("o_orderkey").alias("query_id"), record.alias("sql"))


@query(
    "sql_robustness",
    f"""WITH r AS (SELECT substr(o_orderpriority, 1, 1)::INT AS n, o_orderstatus <> 'P' AS ok, o_totalprice AS ms, 1 AS one FROM orders),
good AS (SELECT one, ms FROM r WHERE ok AND ms > 0), p50 AS ({rank_sql("good", "one", "ms", "50")}), p95 AS ({rank_sql("good", "one", "ms", "95")})
SELECT count(*) AS n_queries, round(avg(ok::INT), 4) AS success_rate, round(avg((ok AND n = 1)::INT), 4) AS first_attempt_rate,
  round(avg((n > 3)::INT), 4) AS relaxation_rate, round(avg(ms) FILTER (WHERE ok AND ms > 0), 6) AS mean_ms,
  (SELECT value FROM p50) AS p50_ms, (SELECT value FROM p95) AS p95_ms FROM r""",
)
def sql_robustness(t):
    return bh.sql_robustness(sql_traces(t))


@query(
    "sql_attempts_distribution",
    "SELECT substr(o_orderpriority, 1, 1)::BIGINT AS attempts, count(*) AS n FROM orders GROUP BY ALL",
)
def sql_attempts_distribution(t):
    return bh.attempts_distribution(sql_traces(t))


ATTEMPTS = """a AS (SELECT o_orderkey, o_totalprice, o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS n FROM orders),
e AS (SELECT *, unnest(range(1, n + 1)) AS i FROM a)"""


@query(
    "sql_attempts_detail",
    f"""WITH {ATTEMPTS} SELECT CASE WHEN i < n THEN o_orderstatus END AS error_type, count(*) AS n, round(avg(o_totalprice / i), 6) AS generation_ms,
  round(avg(i), 6) AS validation_ms, round(avg(o_totalprice / 100), 6) AS execution_ms FROM e GROUP BY 1""",
)
def sql_attempts_detail(t):
    return bh.attempts_by_error(bh.sql_attempts(sql_traces(t)))


# -- data set statistics ----------------------------------------------------------------------


@query(
    "dataset_distribution",
    """SELECT attribute, value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 4) AS pct FROM
  (SELECT 'lang' AS attribute, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL""",
)
def dataset_distribution(t):
    return st.distribution(t.documents, ["lang", "source"])


@query(
    "partition_type_crosstab",
    """SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de,
  count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es, count(*) AS total FROM documents GROUP BY source""",
)
def partition_type_crosstab(t):
    return st.crosstab(t.documents, "source", "lang", ["en", "de", "fr", "es"])


@query(
    "query_length_stats",
    r"""WITH m AS (SELECT role, length(text) AS chars, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS words FROM conversations)
SELECT CASE WHEN grouping(role) = 1 THEN 'overall' ELSE role END AS part,
  round(avg(chars), 4) AS chars_mean, round(stddev_pop(chars), 4) AS chars_std, min(chars) AS chars_min, max(chars) AS chars_max,
  round(avg(words), 4) AS words_mean, round(stddev_pop(words), 4) AS words_std, min(words) AS words_min, max(words) AS words_max
FROM m GROUP BY ROLLUP (role)""",
)
def query_length_stats(t):
    return st.length_stats(t.conversations, "text", "role")


@query(
    "subject_distribution",
    """SELECT source, count(*) AS n, (SELECT count(DISTINCT source) FROM documents WHERE lang <> 'en') AS n_subjects FROM documents
  WHERE lang <> 'en' GROUP BY source""",
)
def subject_distribution(t):
    kept = t.documents.filter("lang <> 'en'")
    counts = kept.groupBy("source").agg(F.count("*").alias("n"))
    distinct = one_row(kept.agg(F.count_distinct("source").alias("n")))["n"]
    return counts.withColumn("n_subjects", distinct)


@query(
    "vocabulary_overlap",
    r"""WITH q AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w FROM benchmark) WHERE length(w) > 2),
c AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[_\-. ]+')) AS w FROM documents) WHERE w <> '')
SELECT count(*) AS n_words, count(c.w) AS n_overlap, round(100 * count(c.w) / count(*), 4) AS pct FROM q LEFT JOIN c USING (w)""",
)
def vocabulary_overlap(t):
    return st.vocabulary_overlap(t.benchmark, t.documents.select(F.col("text").alias("name")))


@query(
    "behaviour_distribution",
    """WITH r AS (SELECT (props->>'$.k')::INT AS k FROM events)
SELECT CASE k % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'hybrid' ELSE 'unstructured' END AS routing, count(*) AS n,
  count(*) FILTER (WHERE k > 50) AS crag_should_rewrite, count(*) FILTER (WHERE k % 2 = 0) AS requires_metadata_filter FROM r GROUP BY 1""",
)
def behaviour_distribution(t):
    k = F.from_json("props", "k int")["k"]
    route = F.when(k % 3 == 0, "structured").when(k % 3 == 1, "hybrid").otherwise("unstructured")
    record = F.struct(
        route.alias("routing"),
        (k > 50).alias("crag_should_rewrite"),
        (k % 2 == 0).alias("requires_metadata_filter"),
    )
    return st.behaviours(
        t.events.select(record.alias("expected")),
        "expected",
        ["crag_should_rewrite", "requires_metadata_filter"],
    )


@query(
    "pseudonymise_ids",
    """WITH ids AS (SELECT DISTINCT id::VARCHAR AS real FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT o_custkey FROM orders UNION ALL SELECT user_id FROM events)),
ranked AS (SELECT real, row_number() OVER (ORDER BY sha256('42:' || real), real) - 1 AS place FROM ids),
map AS (SELECT real, (10000000 + (place * 1005043) % 90000000)::VARCHAR AS fake FROM ranked)
SELECT 'customer' AS "table", c_custkey AS row_id, fake FROM customer JOIN map ON real = c_custkey::VARCHAR
UNION ALL SELECT 'orders', o_orderkey, fake FROM orders JOIN map ON real = o_custkey::VARCHAR
UNION ALL SELECT 'events', event_id, fake FROM events JOIN map ON real = user_id::VARCHAR""",
)
def pseudonymise_ids(t):
    mapping = materialise(
        st.pseudonym_map([(t.customer, "c_custkey"), (t.orders, "o_custkey"), (t.events, "user_id")])
    )
    out = None
    for name, frame, row_id, column in (
        ("customer", t.customer.withColumn("row_id", F.col("c_custkey")), "row_id", "c_custkey"),
        ("orders", t.orders, "o_orderkey", "o_custkey"),
        ("events", t.events, "event_id", "user_id"),
    ):
        replaced = st.pseudonymise(frame.select(F.col(row_id).alias("row_id"), column), column, mapping)
        part = replaced.select(F.lit(name).alias("table"), "row_id", F.col(column).alias("fake"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "pseudonymised_cells",
    """SELECT 'customer' AS "table", count(*) AS rows, count(c_custkey) AS touched, 0 AS unknown FROM customer
UNION ALL SELECT 'orders', count(*), count(o_custkey) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer)),
  count(o_custkey) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders
UNION ALL SELECT 'events', count(*), count(user_id) FILTER (WHERE user_id IN (SELECT c_custkey FROM customer)),
  count(user_id) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer)) FROM events""",
)
def pseudonymised_cells(t):
    """Cells that a map of the customers' ids touches, counted while the replaced tables are written."""
    mapping = materialise(st.pseudonym_map([(t.customer, "c_custkey")]))
    rows = []
    for name, column in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id")):
        replaced, seen = st.pseudonymise_counted(getattr(t, name), column, mapping)
        replaced.write.parquet(f"{shared_folder(t.spark)}/pseudonyms-{uuid.uuid4().hex}")
        got = seen.get
        rows.append((name, got["rows"], got["touched"], got["unknown"]))
    return t.spark.createDataFrame(rows, "table string, rows long, touched long, unknown long")


@query(
    "retrieved_docs_flat",
    """WITH d AS (SELECT page_id::VARCHAR AS query_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda p: p <> '') AS docs FROM pages)
SELECT query_id, generate_subscripts(docs, 1) AS rank, unnest(docs) AS file_name FROM d""",
)
def retrieved_docs_flat(t):
    parts = F.filter(F.split(F.regexp_replace("url", "^https?://", ""), "/"), lambda p: p != "")
    return trace.retrieved_docs(
        t.pages.select(F.col("page_id").cast("string").alias("query_id"), parts.alias("retrieved_docs"))
    )
