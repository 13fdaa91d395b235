"""Nothing is cut, dropped or ended by the size of an input, and every question counts."""

import pytest
from pyspark.sql import functions as F

from quaero.functions import sqltext
from quaero.operators import context as cx
from quaero.operators import corrective as co
from quaero.operators import dataset as st
from quaero.operators import dense, lexical
from quaero.operators import relational as rel
from quaero.operators import retrieval_metrics as rm
from quaero.sources import files


def test_a_statement_of_100_000_characters_is_cleaned(spark):
    long = "SELECT a FROM t WHERE b IN (" + ", ".join(f"'v;{k}'" for k in range(12_000)) + ")"
    assert len(long) > 100_000
    df = spark.createDataFrame([(f"```sql\n{long}; DROP TABLE x\n```",), (f"{long} 'open",)], "r string")
    got = [r["s"] for r in df.select(sqltext.clean_sql_response(F.col("r")).alias("s")).collect()]
    assert got[0].startswith(long) and got[1].startswith(long)


def test_templates_are_filled_once(spark):
    df = spark.createDataFrame([("{a}-{b}-{c}{a}", "{b}", "x"), ("{b}", None, None), ("none", "1", "2")], "t string, a string, b string")
    got = [r["f"] for r in df.select(cx.fill_template(F.col("t"), a=F.col("a"), b=F.col("b")).alias("f")).collect()]
    assert got == ["{b}-x-{c}{b}", "", "none"]


def test_all_rows_are_told(spark):
    df = spark.range(250)
    text = rel.result_to_text(df, ["id"]).first()["text"]
    assert text.startswith("Found 250 results") and text.count("\n") == 251
    text = rel.result_to_text(df, ["id"], 3).first()["text"]
    assert text.startswith("Found 250 results") and text.count("\n") == 4
    assert rel.result_to_text(df.filter("id = 7"), ["id"], 3).first()["text"] == "Result: 7"


def test_all_sources_are_wrapped(spark):
    hits = spark.range(150).selectExpr("1 AS query_id", "id + 1 AS rank", "'c' || id AS content")
    assert cx.wrap_sources(hits).first()["text"].count("<BEGIN SOURCE>") == 150


def test_every_scalar_column_has_samples(spark):
    df = spark.sql("SELECT 1.5D a, 2.5F b, 1.25BD c, timestamp'2024-01-02 03:04:05' d, 3Y e, 'x' f, true g, array(1) h")
    got = {r["column_name"]: r["samples"] for r in rel.profile_table("t", df, (), {}).collect()}
    assert got["a"] == ["1.500000"] and got["b"] == ["2.500000"] and got["c"] == ["1.25"]
    assert got["d"] == ["2024-01-02 03:04:05"] and got["e"] == ["3"] and got["g"] == ["true"] and got["h"] is None


@pytest.mark.parametrize("n", [0, 1, 1000, 9 * 10**7, 9 * 10**7 + 1, 10**11])
def test_codes_grow_with_the_ids(n):
    first = st.code_space(n)
    assert first >= 10**7 and n <= 9 * first and (first == 10**7 or n > 9 * first // 10)


def test_questions_without_a_filter_value_search_all(spark):
    items = spark.createDataFrame([(1, "red fox", "en"), (2, "red hen", "de"), (3, "blue fox", None)], "item_id long, text string, match string")
    asked = spark.createDataFrame([(1, "red fox", "en"), (2, "red fox", None), (3, "red fox", "fr")], "query_id long, text string, match string")
    found = lexical.bm25_topk(asked, lexical.build_index(items), 5, matched=True)
    by_query = {q: {r["item_id"] for r in found.collect() if r["query_id"] == q} for q in (1, 2, 3)}
    assert by_query == {1: {1}, 2: {1, 2, 3}, 3: set()}
    plain = lexical.bm25_topk(asked, lexical.build_index(items.drop("match")), 5)
    kept = lexical.keep_matching(plain, items, asked, 5)
    assert {q: {r["item_id"] for r in kept.collect() if r["query_id"] == q} for q in (1, 2, 3)} == by_query
    vector = F.array(F.lit(1.0), F.col("item_id").cast("double"))
    near = dense.vector_topk(
        asked.withColumn("vector", F.array(F.lit(1.0), F.lit(0.5))), items.withColumn("vector", vector), 5, matched=True
    ).collect()
    assert {q: {r["item_id"] for r in near if r["query_id"] == q} for q in (1, 2, 3)} == by_query


def test_questions_without_hits_count(spark):
    judged = spark.createDataFrame([(1, 1, True, "f")], "query_id long, rank int, relevant boolean, name string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    rows = {r["query_id"]: r for r in rm.per_query(judged, [3], asked=asked).collect()}
    assert rows[1]["hit"] == 1.0 and [rows[2][m] for m in rm.METRICS] == [0.0] * 4
    failed = rm.failures(judged, 3, "name", asked=asked).collect()
    assert [(r["query_id"], r["top_3"]) for r in failed] == [(2, "")]
    graded = spark.createDataFrame([(1, "RELEVANT")], "query_id long, grade string")
    counts = co.grade_counts(graded, asked)
    weak = {r["query_id"] for r in counts.filter(co.needs_rewrite(counts)).collect()}
    assert weak == {2} and counts.filter("query_id = 2").first()["total"] == 0


def test_html_in_capitals_with_attributes_and_entities(spark):
    page = (
        '<HTML><HEAD x="y"><TITLE lang="x">A &eacute;&#233;&#xE9; &amp;lt;</TITLE></HEAD><BODY><NAV id=n>no</NAV>'
        '<H1 class="k">One &copy;</H1><SCRIPT type="t">no()</SCRIPT><p>b &unknown; &nbsp; c &lt;</p></BODY></HTML>'
    )
    df = spark.createDataFrame([(page,), (None,), ("a & b",)], "h string")
    rows = df.select(
        files.html_title(F.col("h")).alias("t"), files.html_headings(F.col("h")).alias("hs"), files.html_to_text(F.col("h")).alias("x")
    ).collect()
    assert tuple(rows[0]) == ("A ééé &lt;", ["One ©"], "One © b &unknown; c <")
    assert tuple(rows[1]) == (None, None, None) and rows[2]["x"] == "a & b"
