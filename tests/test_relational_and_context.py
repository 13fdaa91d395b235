import re

import pytest
from pyspark.sql import functions as F

from quaero.functions import sqltext
from quaero.operators import context as cx
from quaero.operators import relational as rel
from quaero.options import ContextOptions

TABLES = ("users", "orders", "products")
VALID = [
    "SELECT id, name FROM users WHERE active = 1",
    "SELECT u.name, COUNT(o.id) FROM users u JOIN orders o ON u.id = o.user_id GROUP BY u.name",
    "SELECT name FROM users WHERE id IN (SELECT user_id FROM orders)",
    "SELECT name FROM users UNION SELECT name FROM products",
    "SELECT * FROM users",
    "select 1 from users;",
]
INVALID = [
    "INSERT INTO users VALUES (1)",
    "UPDATE users SET a = 1",
    "DELETE FROM users",
    "DROP TABLE users",
    "ALTER TABLE users ADD x INT",
    "CREATE TABLE x (a INT)",
    "SELECT 1 FROM users; DROP TABLE users",
    "SELECT SLEEP(5) FROM users",
    "SELECT 1 FROM users; -- x",
    "SELECT a FROM users WHERE n = '' OR '1'='1'",
    "SELECT a FROM secrets",
    "SELECT xp_cmd FROM users",
    "WITH x AS (SELECT 1) SELECT * FROM x",
    "",
    "   ",
]


def test_audit_outcomes(spark):
    texts = VALID + INVALID
    log = spark.createDataFrame(list(enumerate(texts)), "id long, sql string")
    got = {r["id"]: r for r in rel.audit(log, "sql", TABLES).collect()}
    for i, text in enumerate(texts):
        assert got[i]["is_valid"] is (text in VALID), (text, got[i]["errors"])
    assert got[VALID.index("SELECT * FROM users")]["warnings"] == ["SELECT * may return excessive data"]
    assert got[len(texts) - 1]["errors"] == ["Empty query"]


def test_complexity_limits(spark):
    joins = "SELECT a FROM t" + " JOIN x ON 1" * 4
    nested = "SELECT (SELECT (SELECT (SELECT 1)))"
    df = spark.createDataFrame([(joins,), (nested,), ("SELECT a FROM t",)], "s string")
    got = [r[0] for r in df.select(sqltext.sql_warnings(F.col("s"))).collect()]
    assert got == [["Complex query with 4 JOINs"], ["Query has 3 subqueries"], []]


@pytest.mark.parametrize(
    "response, want",
    [
        ("```sql\nSELECT 1;\n```", "SELECT 1"),
        ("```\nselect a from t\n```", "select a from t"),
        ("SQL: SELECT a FROM t WHERE b = 'x;y'; DROP TABLE t", "SELECT a FROM t WHERE b = 'x;y'"),
        ("Sure: SELECT 2", "SELECT 2"),
        ("nothing here", "nothing here"),
        ("SELECT 'it''s; fine' ; SELECT 3", "SELECT 'it''s; fine'"),
    ],
)
def test_clean_response(spark, response, want):
    df = spark.createDataFrame([(response,)], "r string")
    assert df.select(sqltext.clean_sql_response(F.col("r")).alias("x")).first()["x"] == want


def test_comments_are_stripped_and_listed(spark):
    df = spark.createDataFrame([("SELECT a -- note\nFROM t /* x\ny */ ; ",)], "s string")
    clean, changes = sqltext.strip_comments(F.col("s"))
    got = df.select(clean.alias("c"), changes.alias("l")).first()
    assert re.sub(r"\s+", " ", got["c"]) == "SELECT a FROM t"
    assert got["l"] == ["Removed trailing semicolon", "Removed line comments", "Removed block comments"]


def test_batch_runs_counts_and_errors(spark):
    spark.range(5).toDF("id").createOrReplaceTempView("users")
    statements = {"ok": "SELECT id FROM users WHERE id > 1", "bad": "SELECT nope FROM users", "no": "DROP TABLE users"}
    got = {r["name"]: r for r in rel.run_sql_batch(spark, statements, TABLES).collect()}
    assert (got["ok"]["success"], got["ok"]["row_count"]) == (True, 3)
    assert not got["bad"]["success"] and len(got["bad"]["error"]) <= 203 and "\n" not in got["bad"]["error"]
    assert got["no"]["error"].startswith("Query validation failed")


def test_result_texts(spark):
    df = spark.createDataFrame([(2, "b|c"), (1, None)], "id int, name string")
    text = rel.result_to_text(df, ["id"]).first()["text"]
    assert text == "Found 2 results with columns: id, name.\n1. id=1, name=None\n2. id=2, name=b|c\n"
    assert rel.result_to_text(df.filter("id = 2"), ["id"]).first()["text"] == "Found: id: 2, name: b|c"
    assert rel.result_to_text(df.agg(F.count("*").alias("n")), ["n"]).first()["text"] == "Result: 2"
    assert rel.result_to_text(df.filter("id > 5"), ["id"]).first()["text"] == "The query returned no results."
    table = rel.result_to_markdown(df, ["id"], 1).first()["text"]
    assert table == "| id | name |\n|---|---|\n| 1 | None |\n\n*Showing 1 of 2 rows*"


def test_profile_and_schema_text(spark):
    df = spark.createDataFrame([(1, "b", 1.5), (2, "a", None), (3, None, 2.5)], "id int, name string, price double")
    profile = rel.profile_table("items", df, ["id"], {"name": "names.name"}, samples=2)
    got = {r["column_name"]: r for r in profile.collect()}
    assert got["name"]["samples"] == ["a", "b"] and got["name"]["non_null"] == 2 and got["id"]["is_pk"]
    assert got["price"]["samples"] == ["1.500000", "2.500000"]
    assert rel.schema_text(profile).first()["text"] == (
        "TABLE items\n  id (int) PK [e.g., 1, 2]\n  name (string) FK→names.name [e.g., a, b]\n  price (double) [e.g., 1.500000, 2.500000]\n  FOREIGN KEYS: name→names.name\n  (~3 rows)"
    )


def test_relaxing_levels_against_direct_search(spark):
    values = ["Cold Bolt", "cold bolt m4", "Warm nut", "nut", "x"]
    wanted = ["nut", "bolt m4", "COLD", "ancient bolt", "nothing", "Bolt", "", "x"]
    rows = spark.createDataFrame([(v,) for v in values for _ in range(2)], "value string")
    predicates = spark.createDataFrame(list(enumerate(wanted)), "pred_id long, wanted string")
    got = {r["pred_id"]: (r["level"], r["row_count"]) for r in rel.relax_text_filters(predicates, rows).collect()}
    for i, w in enumerate(wanted):
        words = sorted(re.findall(r"\w+", w.lower()), key=lambda k: (-len(k), k))
        tests = [
            lambda v: v == w,
            lambda v: w != "" and w in v,
            lambda v: w != "" and w.lower() in v.lower(),
            lambda v: bool(words) and words[0] in v.lower(),
        ]
        want = next(((level, 2 * n) for level, n in ((j, sum(map(f, values))) for j, f in enumerate(tests)) if n), (None, 0))
        assert got[i] == want, w


def cut(spark, database, documents, other, **options):
    df = spark.createDataFrame([(database, documents, other)], "a string, b string, c string")
    column = cx.truncate_context(F.col("a"), F.col("b"), F.col("c"), ContextOptions(**options))
    return df.select(column.alias("x")).first()["x"]


def test_context_cut(spark):
    assert cut(spark, "db", "doc", "other") == "db\n\ndoc\n\nother"
    paragraphs = "\n\n".join(["p" * 98] * 10)
    got = cut(spark, "d" * 500, paragraphs, None, max_chars=600)
    assert got.startswith("d" * 360 + cx.TRUNCATED) and "\n\npp" in got
    # room is 600 - 360 - 20 = 220: two paragraphs of 98 + 2 fit, a third does not
    assert got.count("p" * 98) == 2 and got.endswith(cx.TRUNCATED)
    small_room = cut(spark, "d" * 300, paragraphs, "o" * 50, max_chars=400)
    assert "p" not in small_room
    assert cut(spark, None, paragraphs, "z" * 50, max_chars=700).endswith("z" * 50)


def test_templates(spark):
    df = spark.createDataFrame([("Ask {query_str} with {context_str} {x1}", "q", None)], "t string, q string, c string")
    got = df.select(
        cx.fill_template(F.col("t"), query_str=F.col("q"), context_str=F.col("c")).alias("f"),
        cx.template_variables(F.col("t")).alias("v"),
        cx.has_variables(F.col("t"), "query_str", "context_str").alias("ok"),
        cx.has_variables(F.col("t"), "missing").alias("no"),
    ).first()
    assert got["f"] == "Ask q with  {x1}" and got["v"] == ["query_str", "context_str", "x1"]
    assert got["ok"] and not got["no"]


def test_combination(spark):
    schema = "query_id long, success boolean, content string, error string, ms double"
    tables = spark.createDataFrame([(1, True, "rows", None, 2.0), (2, False, None, "boom", 1.0)], schema)
    documents = spark.createDataFrame([(1, True, "text", None, 3.0), (3, False, None, None, None)], schema)
    got = {r["query_id"]: r for r in cx.combine_sources(tables, documents).collect()}
    assert got[1]["context"] == "=== DATABASE RESULTS ===\nrows\n\n=== DOCUMENT CONTEXT ===\ntext"
    assert (got[1]["sources_used"], got[1]["total_ms"]) == ("structured,unstructured", 5.0)
    assert got[2]["context"] == "=== DATABASE ===\n(Query failed: boom)"
    assert got[2]["summary"] == "Sources: [FAIL] structured"
    assert got[3]["context"] == "Unable to retrieve information from any source."
