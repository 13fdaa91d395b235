"""Selection in rounds, sources with failures, streams that keep totals, lists on first use."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quaero.functions import ranks
from quaero.operators import chunking as ch
from quaero.operators import dataset
from quaero.plans import lexical_search
from quaero.plans.registry import Tables
from quaero.sources import files
from quaero.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("slices", "target"), [(4, 5), (3, 1), (8, 40)])
def test_selection_in_rounds_orders_few_values(spark, monkeypatch, slices, target):
    rng = random.Random(4)
    rows = [("hot", float(rng.randrange(5_000))) for _ in range(3_000)] + [("cold", float(k)) for k in range(7)]
    rows += [("one", 2.5)] * 50 + [("hot", None)]
    percents = [0, 1, 33, 50, 95, 99.9, 100]
    df = spark.createDataFrame(rows, "g string, v double")
    calls = []
    keep = ranks.materialise
    monkeypatch.setattr(ranks, "materialise", lambda frame: calls.append(frame.columns) or keep(frame))
    got = {(r["g"], r["pct"]): r["value"] for r in ranks.nearest_rank(df, ["g"], "v", percents, slices, target).collect()}
    for g in ("hot", "cold", "one"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        for p in percents:
            assert got[g, float(p)] == values[min(int(len(values) * p / 100.0), len(values) - 1)]
    assert len(calls) > 2  # the large group went through more than one round
    whole = {r["pct"]: r["value"] for r in ranks.nearest_rank(df, [], "v", percents, slices, target).collect()}
    values = sorted(v for _, v in rows if v is not None)
    assert whole == {float(p): values[min(int(len(values) * p / 100.0), len(values) - 1)] for p in percents}


def test_every_file_is_read_or_fails_with_its_reason(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "good.txt").write_text("naïve\ntext", encoding="utf-8")
    (folder / "empty.md").write_bytes(b"")
    (folder / "latin.txt").write_bytes("naïve".encode("latin-1"))
    (folder / "large.txt").write_text("x" * 200)
    (folder / "skipped.pdf").write_text("no")
    rows, failures = files.read_with_failures(spark, str(tmp_path / "in"), max_bytes=100)
    assert [(r["file_name"], r["text"]) for r in rows.collect()] == [("good.txt", "naïve\ntext")]
    assert {r["file_name"]: r["reason"] for r in failures.collect()} == {
        "latin.txt": "not UTF-8", "large.txt": "too large",
    }


def test_references_frequent_and_rare(spark):
    texts = ["a &amp;lt; b", "&lt;&gt;&quot;&apos;&nbsp;x", "&eacute; &amp; &unknown; &#39;&#x41;", "no reference", "&", "&amp;amp;eacute;", "&AMP; &lt", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(files.resolve_entities(F.col("t"))).collect()]
    slow = [r[0] for r in df.select(F.when(F.contains("t", F.lit("&")), files._resolve_any(F.col("t"))).otherwise(F.col("t"))).collect()]
    assert got == slow
    assert got[0] == "a &lt; b" and got[2] == "é & &unknown; 'A" and got[5] == "&amp;eacute;"


def test_records_without_copies(spark):
    rows = [("a", "x", None), ("a", "x", None), ("a", "x", 1), ("b", "x", None)]
    df = spark.createDataFrame(rows, "contentType string, text string, n int")
    assert sorted(map(str, files.unique_records(df).collect())) == sorted(map(str, df.distinct().collect()))


def test_touched_cells_are_counted_in_the_same_pass(spark):
    df = spark.createDataFrame([("1", 1), (" 2 ", 2), (None, 3), ("", 4), ("9", 5), ("1", 6)], "id string, row int")
    mapping = spark.createDataFrame([("1", "f1"), ("2", "f2")], "real string, fake string")
    replaced, seen = dataset.pseudonymise_counted(df, "id", mapping)
    got = {r["row"]: r["id"] for r in replaced.collect()}
    assert got == {1: "f1", 2: "f2", 3: None, 4: "", 5: "9", 6: "f1"}
    assert seen.get == {"rows": 6, "touched": 3, "unknown": 1}


def test_numbers_of_any_chunker(spark):
    docs = spark.createDataFrame([(k, "Word. " * (40 * (k % 4))) for k in range(9)], "file_id long, text string")
    chunks = ch.chunk_fixed(docs, ch.ChunkOptions(size=16, overlap=2))
    rows = ch.number_chunks(chunks).select("file_id", "chunk_index", "corpus_index").collect()
    assert [r["corpus_index"] for r in sorted(rows)] == list(range(len(rows))) and len(rows) > 20


def test_a_file_that_arrives_again_counts_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "file_id long, source string, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        flows.run_file_totals(stream, ch.chunk_char_windows, out, state).awaitTermination()
        return {r["file_id"]: (r["chunks"], r["tokens"]) for r in flows.totals_now(spark.read.parquet(out)).collect()}

    arrive([(1, "a", "x" * 400), (2, "a", "y" * 9000)])
    arrive([(1, "a", "z" * 40)])
    assert run() == {1: (1, 10), 2: (3, sum(len(c) // 4 for c in ("y" * 4000, "y" * 4000, "y" * 1400)))}
    arrive([(2, "a", "w" * 8), (3, "b", "v" * 12)])
    assert run() == {1: (1, 10), 2: (1, 2), 3: (1, 3)}  # after a restart too
    changes = spark.read.parquet(out)
    assert changes.agg(F.sum(F.col("tokens") - F.col("tokens_before"))).first()[0] == 15
    assert changes.groupBy("file_id", "version").count().where("count > 1").count() == 0


def test_lists_that_no_configuration_asks_for_are_not_made(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(lexical_search, "dense_hits", lambda *a, matched=False, **k: asked.append(("dense", matched)) or lexical_search.lexical.bm25_topk(lexical_search.questions(t), lexical_search.index(t), 3))
    t = Tables(spark, SF)
    lexical_search.ablation_runs(t, lexical_search.some_configs("C1", "C2"))
    assert asked == [("dense", False)]


@pytest.mark.parametrize("key", ["read_with_failures", "stream_file_totals", "pseudonymised_cells", "number_chunks", "import_records_unique", "chunk_fixed", "chunk_parts", "percentile_ladder"])
def test_twins_of_new_queries_agree(spark, key):
    from tests.test_plans import test_twins_agree

    test_twins_agree(spark, key)
    assert key in entry.oracle_sql()


@pytest.mark.parametrize("files", [None, 3])
def test_stream_queries_read_tables_of_one_or_many_files(spark, tmp_path, files):
    import datetime

    import pyarrow.parquet as pq

    from quaero import plans

    start = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(i, start + datetime.timedelta(minutes=i), "a", float(i)) for i in range(300)],
        "event_id long, ts timestamp_ntz, event_type string, value double",
    )
    docs = spark.createDataFrame([(i, f"s{i % 2}", "word " * 900) for i in range(5)], "doc_id long, source string, text string")
    for name, df in (("events", events), ("documents", docs)):
        path = tmp_path / f"{name}.parquet"
        if files:
            df.repartition(files).write.parquet(str(path))
        else:
            pq.write_table(df.toArrow(), path)
    chunks = plans.BUILDERS["stream_ingest_chunks"](spark, str(tmp_path)).collect()
    assert sorted((r.file_id, r.chunks) for r in chunks) == [(i, 2) for i in range(5)]
    closed = plans.BUILDERS["stream_trace_metrics"](spark, str(tmp_path)).collect()
    assert sorted(r.n for r in closed) == [60] * 4
