from pathlib import Path

import pytest

import __spark_entry__ as entry
from quaero.plans.registry import Tables
from quaero.plans import dense_search, lexical_search

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 170


def test_flagship_has_rows(spark):
    got = entry.entry(spark).collect()
    assert {r["k"] for r in got} == {3, 5, 10}
    assert all(r["hit"] >= r["rr"] and r["ndcg"] <= 1 for r in got)


@pytest.mark.parametrize("key", ["vector_topk", "bm25_topk", "match_substring", "relax_text_filters", "link_expand", "percentile_ladder", "pseudonymise_ids"])
def test_no_nested_loops(spark, key):
    text = plan(entry.queries()[key](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ranks_are_limited_before_the_shuffle(spark):
    t = Tables(spark, SF)
    for df in (dense_search.hits(t), lexical_search.lexical_hits(t)):
        assert plan(df).count("WindowGroupLimit") >= 2


def test_bm25_splits_texts_behind_one_exchange(spark):
    text = plan(lexical_search.index(Tables(spark, SF)).postings)
    assert text.count("Exchange hashpartitioning(item_id") == 1


def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["sql_group_count_desc"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "o_totalprice" not in schema


@pytest.mark.parametrize("key", ["vector_topk", "bm25_topk", "hybrid_topk", "audit_sql_log", "stock_balance", "pack_history", "run_variance"])
def test_twins_agree(spark, key):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from '{file}'")
    result = db.sql(entry.oracle_sql()[key])
    names = sorted(result.columns)
    order = [result.columns.index(n) for n in names]
    want = sorted(str(tuple(r[i] for i in order)) for r in result.fetchall())
    got = sorted(str(tuple(r[n] for n in names)) for r in entry.queries()[key](spark, SF).collect())
    assert got == want
