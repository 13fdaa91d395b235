"""The relational path: query shapes, auditing, profiling, running and relaxing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.fixed_values import FORBIDDEN_PATTERNS, INJECTION_PATTERNS
from quaero.functions import sqltext
from quaero.operators import relational as rel
from quaero.operators.sizing import running_sum
from quaero.plans.registry import query
from quaero.sources import tables

# -- query shapes -----------------------------------------------------------------------------


@query("sql_count_all", "SELECT count(*) AS total FROM lineitem")
def sql_count_all(t):
    return t.lineitem.agg(F.count("*").alias("total"))


@query(
    "sql_filter_project_sort",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = 'PROMO' ORDER BY p_name, p_partkey",
)
def sql_filter_project_sort(t):
    kept = t.part.filter(F.col("p_type") == "PROMO")
    return kept.select("p_partkey", "p_name", "p_retailprice").orderBy("p_name", "p_partkey")


@query(
    "sql_group_count_not_null",
    "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY p_brand",
)
def sql_group_count_not_null(t):
    kept = t.part.filter(F.col("p_brand").isNotNull())
    return kept.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand")


@query(
    "sql_group_count_desc",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY n DESC",
)
def sql_group_count_desc(t):
    kept = t.orders.filter(F.col("o_orderstatus") == "F")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("sql_like_lower", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%o%ing%'")
def sql_like_lower(t):
    return t.part.filter(F.lower("p_name").like("%o%ing%")).select("p_partkey", "p_name")


@query(
    "sql_join_distinct",
    "SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def sql_join_distinct(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("n_name", "c_mktsegment").distinct()


@query(
    "sql_join_count_distinct",
    "SELECT count(DISTINCT o_custkey) AS customers FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'",
)
def sql_join_count_distinct(t):
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").select("l_orderkey")
    joined = t.orders.select("o_orderkey", "o_custkey").join(
        returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"
    )
    return joined.agg(F.count_distinct("o_custkey").alias("customers"))


@query(
    "sql_join_group_topk",
    """SELECT p_name, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_name ORDER BY n_orders DESC, p_name LIMIT 5""",
)
def sql_join_group_topk(t):
    joined = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")
    )
    counted = joined.groupBy("p_name").agg(F.count_distinct("l_orderkey").alias("n_orders"))
    return counted.orderBy(F.desc("n_orders"), "p_name").limit(5)


@query(
    "sql_three_way_join",
    """SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey ORDER BY c_custkey""",
)
def sql_three_way_join(t):
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "n_name", "r_name")
        .orderBy("c_custkey")
    )


@query(
    "sql_cast_text_number",
    """SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority FROM orders
WHERE try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) <= 2""",
)
def sql_cast_text_number(t):
    number = F.substring("o_orderpriority", 1, 1).try_cast("bigint")
    return t.orders.select("o_orderkey", number.alias("priority")).filter("priority <= 2")


@query("sql_avg", "SELECT round(avg(p_retailprice), 6) AS avg_price FROM part")
def sql_avg(t):
    return t.part.agg(F.round(F.avg("p_retailprice"), 6).alias("avg_price"))


@query(
    "sql_sum_filtered",
    "SELECT round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F'",
)
def sql_sum_filtered(t):
    kept = t.orders.filter(F.col("o_orderstatus") == "F")
    return kept.agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("sql_count_distinct_users", "SELECT count(DISTINCT user_id) AS users FROM events")
def sql_count_distinct_users(t):
    return t.events.agg(F.count_distinct("user_id").alias("users"))


@query(
    "sql_join_group_top1",
    """SELECT c_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name
ORDER BY n DESC, c_name LIMIT 1""",
)
def sql_join_group_top1(t):
    # orders of a customer are counted before the join, so a hot customer is one row
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = t.customer.join(counts, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c_name").limit(1)


COUNTED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@query(
    "sql_table_row_counts",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in COUNTED)
    + ") SELECT coalesce(name, 'total') AS table_name, sum(n)::BIGINT AS n FROM c GROUP BY ROLLUP (name)",
)
def sql_table_row_counts(t):
    counts = None
    for name in COUNTED:
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    summed = counts.rollup("name").agg(F.sum("n").alias("n"))
    return summed.select(F.coalesce("name", F.lit("total")).alias("table_name"), "n")


@query(
    "sql_in_subquery",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""",
)
def sql_in_subquery(t):
    large = t.orders.filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(large, "c_custkey", "left_semi")


@query(
    "sql_join_agg_group",
    """SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def sql_join_agg_group(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"))


@query(
    "sql_union",
    "SELECT c_nationkey::BIGINT AS nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier",
)
def sql_union(t):
    rich = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("bigint").alias("nationkey"))
    return rich.union(t.supplier.select("s_nationkey")).distinct()


@query("sql_distinct_limit", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5")
def sql_distinct_limit(t):
    return t.part.select("p_brand").distinct().orderBy("p_brand").limit(5)


@query(
    "stock_balance",
    """WITH m AS (SELECT l_partkey, l_shipdate::DATE AS day, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS change FROM lineitem),
d AS (SELECT l_partkey, day, sum(change) AS change FROM m GROUP BY ALL)
SELECT l_partkey, day, change, sum(change) OVER (PARTITION BY l_partkey ORDER BY day ROWS UNBOUNDED PRECEDING) AS stock FROM d""",
)
def stock_balance(t):
    """Running stock per part and day from signed movements (returns in, all else out)."""
    change = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    daily = t.lineitem.groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(
        F.sum(change).alias("change")
    )
    placed = daily.withColumn("position", F.unix_date("day"))
    return running_sum(placed, ["l_partkey"], "position", "change", "stock").drop("position")


@query(
    "net_revenue",
    """SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE 0 END), 2) AS net
FROM orders GROUP BY o_custkey""",
)
def net_revenue(t):
    """Payments (finished orders) minus refunds (pending ones) per customer."""
    signed = (
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
        .when(F.col("o_orderstatus") == "P", -F.col("o_totalprice"))
        .otherwise(0.0)
    )
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum(signed), 2).alias("net"))


@query(
    "order_totals_check",
    """WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS subtotal, sum(l_extendedprice * l_discount) AS discount FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, round(subtotal, 6) AS subtotal, round(discount, 6) AS discount, round(subtotal * 0.21, 7) AS tax,
  round(abs(o_totalprice - subtotal * 1.21), 7) AS difference FROM orders JOIN s ON l_orderkey = o_orderkey""",
)
def order_totals_check(t):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    sums = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(price * (1 - discount)).alias("subtotal"), F.sum(price * discount).alias("discount")
    )
    joined = t.orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        "o_orderkey",
        F.round("subtotal", 6).alias("subtotal"),
        F.round("discount", 6).alias("discount"),
        F.round(F.col("subtotal") * 0.21, 7).alias("tax"),
        F.round(F.abs(F.col("o_totalprice") - F.col("subtotal") * 1.21), 7).alias("difference"),
    )


SCALAR_SQL = """SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
  count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high,
  max(lower(trim(concat(' ', o_orderstatus, ' ')))) AS status, max(upper(replace(o_orderpriority, '-', '_'))) AS priority,
  max(coalesce(nullif(substring(o_orderpriority, 3, 3), 'LOW'), 'none')) AS short, max(length(o_orderpriority)) AS len,
  max(CAST(o_orderkey AS VARCHAR)) AS key_text, max(CAST(o_orderdate AS DATE)) AS date
FROM orders GROUP BY year(o_orderdate), month(o_orderdate), day(o_orderdate)"""


@query("sql_scalar_functions", SCALAR_SQL)
def sql_scalar_functions(t):
    """Every scalar and aggregate function allowed in SQL texts, through the SQL interface."""
    t.orders.createOrReplaceTempView("orders")
    out = t.spark.sql(SCALAR_SQL.replace("VARCHAR", "STRING"))
    whole = ("y", "m", "d", "len")
    return out.withColumns({c: F.col(c).cast("bigint") for c in whole})


# -- auditing SQL texts -----------------------------------------------------------------------

LOG = """
log AS (SELECT event_id AS sql_id, CASE (props->>'$.k')::INT % 17
  WHEN 0 THEN 'SELECT p_name FROM part WHERE p_partkey = ' || user_id
  WHEN 1 THEN '  select count(*)   from orders' || chr(10) || ' join customer on o_custkey = c_custkey ; '
  WHEN 2 THEN 'SELECT * FROM part WHERE p_name = ''x'' OR ''1''=''1'''
  WHEN 3 THEN 'SELECT 1 FROM part; DROP TABLE part'
  WHEN 4 THEN 'SELECT SLEEP (' || user_id || ')'
  WHEN 5 THEN 'DELETE FROM part WHERE p_partkey = ' || user_id
  WHEN 6 THEN '   '
  WHEN 7 THEN 'SELECT a FROM orders JOIN b ON 1 JOIN c ON 1 join d ON 1 JOIN part ON 1'
  WHEN 8 THEN 'SELECT (SELECT (SELECT (SELECT 1))) FROM part'
  WHEN 9 THEN 'WITH x AS (SELECT 1) SELECT * FROM x'
  WHEN 10 THEN 'SELECT a FROM part -- comment'
  WHEN 11 THEN 'SELECT a FROM secret_' || user_id || ';'
  WHEN 12 THEN 'SELECT a FROM part UNION SELECT b FROM supplier;;'
  WHEN 13 THEN 'SELECT ''a;b'' FROM part /* block */'
  WHEN 14 THEN 'SELECT xp_cmdshell(1), EXEC (2) FROM part'
  WHEN 15 THEN 'SELECT a FROM part INTO OUTFILE ''/tmp/x'''
  ELSE 'SELECT a FROM part WHERE b IN (SELECT o_custkey FROM orders); -- x' END AS sql FROM events)"""


def sql_log(t):
    k = F.get_json_object("props", "$.k").cast("int") % 17
    user = F.col("user_id").cast("string")
    texts = [
        F.concat(F.lit("SELECT p_name FROM part WHERE p_partkey = "), user),
        F.lit("  select count(*)   from orders\n join customer on o_custkey = c_custkey ; "),
        F.lit("SELECT * FROM part WHERE p_name = 'x' OR '1'='1'"),
        F.lit("SELECT 1 FROM part; DROP TABLE part"),
        F.concat(F.lit("SELECT SLEEP ("), user, F.lit(")")),
        F.concat(F.lit("DELETE FROM part WHERE p_partkey = "), user),
        F.lit("   "),
        F.lit("SELECT a FROM orders JOIN b ON 1 JOIN c ON 1 join d ON 1 JOIN part ON 1"),
        F.lit("SELECT (SELECT (SELECT (SELECT 1))) FROM part"),
        F.lit("WITH x AS (SELECT 1) SELECT * FROM x"),
        F.lit("SELECT a FROM part -- comment"),
        F.concat(F.lit("SELECT a FROM secret_"), user, F.lit(";")),
        F.lit("SELECT a FROM part UNION SELECT b FROM supplier;;"),
        F.lit("SELECT 'a;b' FROM part /* block */"),
        F.lit("SELECT xp_cmdshell(1), EXEC (2) FROM part"),
        F.lit("SELECT a FROM part INTO OUTFILE '/tmp/x'"),
        F.lit("SELECT a FROM part WHERE b IN (SELECT o_custkey FROM orders); -- x"),
    ]
    return t.events.select(
        F.col("event_id").alias("sql_id"), F.element_at(F.array(*texts), k + 1).alias("sql")
    )


ALLOWED = ("part", "orders", "customer", "supplier")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def messages_sql(patterns, before: str) -> list[str]:
    return [
        f"CASE WHEN regexp_matches(s, {quote('(?i)' + p)}) THEN {quote(before + p + chr(39))} END" for p in patterns
    ]


CHECKS = ", ".join(
    [r"CASE WHEN NOT regexp_matches(s, '(?i)^\s*SELECT\b') THEN 'Only SELECT statements are allowed' END"]
    + messages_sql(INJECTION_PATTERNS, "Potential SQL injection detected: pattern '")
    + messages_sql(FORBIDDEN_PATTERNS, "Forbidden pattern detected: '")
)
AUDIT = (
    LOG
    + rf""",
normal AS (SELECT sql_id, rtrim(regexp_replace(regexp_replace(sql, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), ';') AS s FROM log),
counted AS (SELECT *, len(regexp_extract_all(s, '(?i)\bJOIN\b')) AS joins, (length(s) - length(replace(upper(s), 'SELECT', ''))) // 6 - 1 AS nested FROM normal),
checked AS (SELECT *, CASE WHEN trim(s) = '' THEN ['Empty query'] ELSE list_concat(list_filter([{CHECKS}], lambda e: e IS NOT NULL),
  list_transform(list_filter(regexp_extract_all(s, '(?i)(?:FROM|JOIN|INTO)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1), lambda x: upper(x) NOT IN ('PART', 'ORDERS', 'CUSTOMER', 'SUPPLIER')),
    lambda x: 'Table ''' || x || ''' is not in allowed list')) END AS errors,
  list_filter([CASE WHEN joins > 3 THEN 'Complex query with ' || joins || ' JOINs' END, CASE WHEN nested > 2 THEN 'Query has ' || nested || ' subqueries' END,
    CASE WHEN contains(upper(s), 'SELECT *') THEN 'SELECT * may return excessive data' END], lambda w: w IS NOT NULL) AS warnings FROM counted)"""
)


@query(
    "audit_sql_log",
    f"""WITH {AUDIT} SELECT sql_id, s AS normal_sql, len(errors) = 0 AS is_valid, array_to_string(errors, ' | ') AS errors,
  array_to_string(warnings, ' | ') AS warnings FROM checked""",
)
def audit_sql_log(t):
    return rel.audit(sql_log(t), "sql", ALLOWED).select(
        "sql_id",
        "normal_sql",
        "is_valid",
        F.concat_ws(" | ", "errors").alias("errors"),
        F.concat_ws(" | ", "warnings").alias("warnings"),
    )


@query(
    "sql_complexity",
    f"WITH {AUDIT} SELECT unnest(warnings) AS warning, count(*) AS n FROM checked GROUP BY 1",
)
def sql_complexity(t):
    normal = sqltext.normalise_sql(F.col("sql"))
    warned = sql_log(t).select(F.explode(sqltext.sql_warnings(normal)).alias("warning"))
    return warned.groupBy("warning").agg(F.count("*").alias("n"))


REPLIES = """
replies AS (SELECT event_id AS sql_id, CASE event_type WHEN 'view' THEN 'Here you go:' || chr(10) || '```sql' || chr(10) || 'SELECT a FROM part WHERE b = ' || user_id || ';' || chr(10) || '```' || chr(10) || 'done'
  WHEN 'click' THEN 'SQL: select a from part where c = ''x;y'' ; DELETE FROM part' WHEN 'purchase' THEN '```' || chr(10) || 'Query: SELECT ' || user_id || '; SELECT 2' || chr(10) || '```'
  WHEN 'signup' THEN 'I think SELECT ' || user_id || ' FROM part is right' ELSE 'no idea' END AS response FROM events)"""


def sql_replies(t):
    kind, user = F.col("event_type"), F.col("user_id")
    fence = F.concat(
        F.lit("Here you go:\n```sql\nSELECT a FROM part WHERE b = "), user, F.lit(";\n```\ndone")
    )
    response = (
        F.when(kind == "view", fence)
        .when(kind == "click", "SQL: select a from part where c = 'x;y' ; DELETE FROM part")
        .when(kind == "purchase", F.concat(F.lit("```\nQuery: SELECT "), user, F.lit("; SELECT 2\n```")))
        .when(kind == "signup", F.concat(F.lit("I think SELECT "), user, F.lit(" FROM part is right")))
        .otherwise("no idea")
    )
    return t.events.select(F.col("event_id").alias("sql_id"), response.alias("response"))


@query(
    "clean_sql_responses",
    r"""SELECT event_id AS sql_id, CASE event_type WHEN 'view' THEN 'SELECT a FROM part WHERE b = ' || user_id
  WHEN 'click' THEN 'select a from part where c = ''x;y''' WHEN 'purchase' THEN 'SELECT ' || user_id
  WHEN 'signup' THEN 'SELECT ' || user_id || ' FROM part is right' ELSE 'no idea' END AS sql FROM events""",
)
def clean_sql_responses(t):
    return sql_replies(t).select("sql_id", sqltext.clean_sql_response(F.col("response")).alias("sql"))


@query(
    "strip_sql_comments",
    f"""WITH {LOG}, a AS (SELECT sql_id, sql, regexp_matches(sql, ';\\s*$') AS ends, CASE WHEN regexp_matches(sql, ';\\s*$') THEN regexp_replace(sql, '[;\\s]+$', '') ELSE sql END AS s FROM log),
b AS (SELECT *, contains(s, '--') AS lines, regexp_replace(s, '(?m)--.*$', '', 'g') AS s2 FROM a)
SELECT sql_id, regexp_replace(regexp_replace(s2, '(?s)/\\*.*?\\*/', '', 'g'), '^\\s+|\\s+$', '', 'g') AS sql,
  concat_ws(', ', CASE WHEN ends THEN 'Removed trailing semicolon' END, CASE WHEN lines THEN 'Removed line comments' END,
    CASE WHEN contains(s2, '/*') THEN 'Removed block comments' END) AS changes FROM b""",
)
def strip_sql_comments(t):
    clean, changes = sqltext.strip_comments(F.col("sql"))
    return sql_log(t).select(
        "sql_id", clean.alias("sql"), F.concat_ws(", ", changes).alias("changes")
    )


@query(
    "sql_error_classes",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Deadlock found' || chr(10) || props WHEN 'click' THEN repeat('syntax error ', 20)
  WHEN 'purchase' THEN 'Lock wait timeout' WHEN 'signup' THEN 'no such table' END AS error FROM events)
SELECT event_id, coalesce(regexp_matches(lower(error), 'connection|timeout|deadlock|lock wait|too many connections'), false) AS retry,
  CASE WHEN length(split_part(error, chr(10), 1)) > 200 THEN substr(split_part(error, chr(10), 1), 1, 200) || '...' ELSE split_part(error, chr(10), 1) END AS short FROM e""",
)
def sql_error_classes(t):
    kind = F.col("event_type")
    error = (
        F.when(kind == "view", F.concat(F.lit("Deadlock found\n"), "props"))
        .when(kind == "click", F.lit("syntax error " * 20))
        .when(kind == "purchase", "Lock wait timeout")
        .when(kind == "signup", "no such table")
    )
    return t.events.select("event_id", error.alias("error")).select(
        "event_id",
        sqltext.is_retryable(F.col("error")).alias("retry"),
        sqltext.short_error(F.col("error")).alias("short"),
    )


@query("cap_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def cap_rows(t):
    found = t.orders.select("o_orderkey", "o_totalprice")
    return rel.cap_rows(found, [F.desc("o_totalprice"), "o_orderkey"], 100)


BATCH = {
    "orders_per_status": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "parts_of_type": "SELECT p_name FROM part WHERE p_type = 'PROMO';",
    "rich_customers": "SELECT c_name FROM customer WHERE c_acctbal > 5000",
    "no_such_column": "SELECT nothing_here FROM part",
    "not_allowed": "SELECT n_name FROM nation",
    "not_a_select": "DROP TABLE part",
}


@query(
    "run_sql_batch",
    """SELECT 'orders_per_status' AS name, true AS success, count(DISTINCT o_orderstatus) AS row_count FROM orders
UNION ALL SELECT 'parts_of_type', true, count(*) FROM part WHERE p_type = 'PROMO' UNION ALL SELECT 'rich_customers', true, count(*) FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT 'no_such_column', false, NULL UNION ALL SELECT 'not_allowed', false, NULL UNION ALL SELECT 'not_a_select', false, NULL""",
)
def run_sql_batch(t):
    tables.register_views({n: getattr(t, n) for n in (*ALLOWED, "nation")})
    return rel.run_sql_batch(t.spark, BATCH, ALLOWED).select("name", "success", "row_count")


# -- profiling --------------------------------------------------------------------------------

# columns, primary key and foreign keys of every table: a Parquet file tells no keys
PROFILED = {
    "region": (("r_regionkey int", "r_name string"), ("r_regionkey",), {}),
    "nation": (
        ("n_nationkey int", "n_name string", "n_regionkey int"),
        ("n_nationkey",),
        {"n_regionkey": "region.r_regionkey"},
    ),
    "customer": (
        ("c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double", "c_mktsegment string"),
        ("c_custkey",),
        {"c_nationkey": "nation.n_nationkey"},
    ),
    "supplier": (
        ("s_suppkey bigint", "s_name string", "s_nationkey int", "s_acctbal double"),
        ("s_suppkey",),
        {"s_nationkey": "nation.n_nationkey"},
    ),
    "part": (
        ("p_partkey bigint", "p_name string", "p_brand string", "p_type string", "p_size int", "p_retailprice double"),
        ("p_partkey",),
        {},
    ),
    "orders": (
        ("o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double",
         "o_orderdate timestamp_ntz", "o_orderpriority string"),
        ("o_orderkey",),
        {"o_custkey": "customer.c_custkey"},
    ),
    "lineitem": (
        ("l_orderkey bigint", "l_partkey bigint", "l_suppkey bigint", "l_linenumber int", "l_quantity double",
         "l_extendedprice double", "l_discount double", "l_tax double", "l_returnflag string", "l_linestatus string",
         "l_shipdate timestamp_ntz"),
        ("l_orderkey", "l_linenumber"),
        {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
    ),
    "events": (
        ("event_id bigint", "ts timestamp_ntz", "user_id bigint", "event_type string", "value double", "props string"),
        ("event_id",),
        {},
    ),
    "documents": (
        ("doc_id bigint", "text string", "lang string", "source string", "n_chars bigint"),
        ("doc_id",),
        {},
    ),
    "embeddings": (("vec_id bigint", "embedding array<float>", "label int"), ("vec_id",), {}),
    "pages": (("page_id bigint", "url string", "html string"), ("page_id",), {}),
    "benchmark": (("item_id bigint", "text string"), ("item_id",), {}),
    "labels": (("doc_id bigint", "quality int", "toxic int"), ("doc_id",), {"doc_id": "documents.doc_id"}),
    "conversations": (("conv_id bigint", "turn bigint", "role string", "text string"), ("conv_id", "turn"), {}),
}
DESCRIBED = {"documents": "Texts of the corpus", "labels": "Judgements of documents"}
DESCRIBED_COLUMNS = {"documents": {"lang": "language code"}, "labels": {"quality": "1 is good", "toxic": "1 is toxic"}}


def profile_sql() -> str:
    text = lambda value: "NULL" if value is None else quote(value)
    parts = []
    for table, (columns, primary, foreign) in PROFILED.items():
        for i, column in enumerate(columns):
            name, kind = column.split()
            value = f"{name}::DECIMAL(38, 6)::VARCHAR" if kind == "double" else f"substr({name}::VARCHAR, 1, 100)"
            samples = f"""(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {value} AS v FROM {table}
  WHERE {name} IS NOT NULL ORDER BY v LIMIT 5))"""
            if kind.startswith("array"):
                samples = "NULL::VARCHAR[]"
            told = DESCRIBED_COLUMNS.get(table, {}).get(name)
            parts.append(
                f"""SELECT '{table}' AS table_name, {text(DESCRIBED.get(table))}::VARCHAR AS table_description, {i}::BIGINT AS position,
  '{name}' AS column_name, '{kind}' AS type, {str(name in primary).lower()} AS is_pk, {text(foreign.get(name))}::VARCHAR AS fk,
  {str(name not in primary).lower()} AS nullable, {text(told)}::VARCHAR AS description,
  (SELECT count(*) FROM {table}) AS row_count, (SELECT count({name}) FROM {table}) AS non_null, {samples} AS samples"""
            )
    return "profile AS (" + " UNION ALL ".join(parts) + ")"


def profile(t):
    out = None
    for name, (_, primary, foreign) in PROFILED.items():
        one = rel.profile_table(
            name,
            getattr(t, name),
            primary,
            foreign,
            not_null=primary,
            description=DESCRIBED.get(name),
            column_descriptions=DESCRIBED_COLUMNS.get(name),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("profile_schema", f"WITH {profile_sql()} SELECT * REPLACE (array_to_string(samples, ', ') AS samples) FROM profile")
def profile_schema(t):
    return profile(t).withColumns(
        {
            "samples": F.when(F.col("samples").isNotNull(), F.concat_ws(", ", "samples")),
            "position": F.col("position").cast("bigint"),
        }
    )


LINE = """'  ' || column_name || ' (' || type || ')' || CASE WHEN is_pk THEN ' PK' ELSE '' END || coalesce(' FK→' || fk, '')"""


@query(
    "schema_text",
    f"""WITH {profile_sql()}, lines AS (SELECT *, {LINE} || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END ||
  coalesce(' -- ' || description, '') || coalesce(' [e.g., ' || array_to_string(samples[1:3], ', ') || ']', '') AS line FROM profile)
SELECT table_name, 'TABLE ' || table_name || coalesce(chr(10) || '  -- ' || max(table_description), '') || chr(10) ||
  string_agg(line, chr(10) ORDER BY position) ||
  coalesce(chr(10) || '  FOREIGN KEYS: ' || string_agg(column_name || '→' || fk, ', ' ORDER BY position) FILTER (WHERE fk IS NOT NULL), '') ||
  chr(10) || '  (~' || max(row_count) || ' rows)' AS text
FROM lines GROUP BY table_name""",
)
def schema_text(t):
    return rel.schema_text(profile(t))


@query("schema_lines_for_router", f"WITH {profile_sql()} SELECT table_name, position, {LINE} AS line FROM profile")
def schema_lines_for_router(t):
    return rel.schema_lines_for_router(profile(t)).withColumn("position", F.col("position").cast("bigint"))


@query(
    "result_to_text",
    """WITH r AS (SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
l AS (SELECT row_number() OVER (ORDER BY r_name) AS i, r_name, nations, count(*) OVER () AS n FROM r)
SELECT 'many' AS kind, 'Found ' || max(n) || ' results with columns: r_name, nations.' || chr(10) ||
  string_agg(i || '. r_name=' || r_name || ', nations=' || nations || chr(10), '' ORDER BY i) AS text FROM l
UNION ALL SELECT 'all', 'Found ' || count(*) || ' results with columns: s_suppkey, c_custkey.' || chr(10) ||
  string_agg(i || '. s_suppkey=' || s_suppkey || ', c_custkey=' || c_custkey || chr(10), '' ORDER BY i)
  FROM (SELECT row_number() OVER (ORDER BY s_suppkey, c_custkey) AS i, * FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal < 0)
UNION ALL SELECT 'one', 'Found: orders: ' || count(*) || ', biggest: ' || max(o_orderkey) FROM orders
UNION ALL SELECT 'value', 'Result: ' || count(*) FROM lineitem
UNION ALL SELECT 'none', 'The query returned no results.'
UNION ALL SELECT 'markdown', '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) ||
  (SELECT string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 20)) ||
  CASE WHEN count(*) > 20 THEN chr(10) || chr(10) || '*Showing 20 of ' || count(*) || ' rows*' ELSE '' END FROM nation""",
)
def result_to_text(t):
    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    shapes = {
        "many": (regions.groupBy("r_name").agg(F.count("*").alias("nations")), ["r_name"]),
        "all": (
            t.supplier.join(t.customer, F.col("s_nationkey") == F.col("c_nationkey"))
            .filter("c_acctbal < 0")
            .select("s_suppkey", "c_custkey"),
            ["s_suppkey", "c_custkey"],
        ),
        "one": (t.orders.agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("biggest")), ["orders"]),
        "value": (t.lineitem.agg(F.count("*").alias("n")), ["n"]),
        "none": (t.orders.filter("o_totalprice < 0").select("o_orderkey"), ["o_orderkey"]),
    }
    out = rel.result_to_markdown(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    out = out.select(F.lit("markdown").alias("kind"), "text")
    for kind, (df, order) in shapes.items():
        text = rel.result_to_text(df, order).select(F.lit(kind).alias("kind"), "text")
        out = out.unionByName(text)
    return out


@query(
    "relax_text_filters",
    r"""WITH preds AS (SELECT p_partkey AS pred_id, CASE p_type WHEN 'PROMO' THEN p_name WHEN 'SMALL' THEN substr(p_name, 2) WHEN 'LARGE' THEN upper(p_name)
  WHEN 'MEDIUM' THEN 'galactic ' || split_part(p_name, ' ', 1) || 'x' ELSE 'the ' || split_part(p_name, ' ', 2) END AS wanted FROM part),
keyed AS (SELECT *, list_sort(list_transform(list_filter(regexp_split_to_array(lower(wanted), '[^\p{L}\p{N}_]+'), lambda w: w <> ''), lambda w: {'l': -length(w), 'w': w}))[1].w AS keyword FROM preds),
vals AS (SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name),
hits AS (SELECT pred_id, 0 AS level, n FROM keyed JOIN vals ON value = wanted UNION ALL SELECT pred_id, 1, n FROM keyed, vals WHERE contains(value, wanted)
  UNION ALL SELECT pred_id, 2, n FROM keyed, vals WHERE contains(lower(value), lower(wanted)) UNION ALL SELECT pred_id, 3, n FROM keyed, vals WHERE contains(lower(value), keyword)),
per_level AS (SELECT pred_id, level, sum(n) AS n FROM hits GROUP BY ALL),
best AS (SELECT pred_id, min(level) AS level, arg_min(n, level) AS n FROM per_level GROUP BY pred_id)
SELECT pred_id, level::BIGINT AS level, coalesce(n, 0)::BIGINT AS row_count FROM preds LEFT JOIN best USING (pred_id)""",
)
def relax_text_filters(t):
    name, kind = F.col("p_name"), F.col("p_type")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    wanted = (
        F.when(kind == "PROMO", name)
        .when(kind == "SMALL", F.substring(name, 2, 100))
        .when(kind == "LARGE", F.upper(name))
        .when(kind == "MEDIUM", F.concat(F.lit("galactic "), first, F.lit("x")))
        .otherwise(F.concat(F.lit("the "), second))
    )
    predicates = t.part.select(F.col("p_partkey").alias("pred_id"), wanted.alias("wanted"))
    return rel.relax_text_filters(predicates, t.part.select(F.col("p_name").alias("value")))
