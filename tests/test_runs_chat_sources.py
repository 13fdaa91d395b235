import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quaero.functions.ranks import nearest_rank, nearest_rank_wide
from quaero.operators import chat, dataset, latency, sizing
from quaero.operators import metadata as md
from quaero.sources import files, store, tables, trace
from quaero.streaming import flows


def place(values, p):
    s = sorted(values)
    return s[min(int(len(s) * p / 100), len(s) - 1)]


def test_percentile_hand_case(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert nearest_rank_wide(df, [], "v", {"p50": 50, "p95": 95}).first() == (6.0, 10.0)


def test_percentiles_against_sorting_with_a_hot_group_and_a_hot_value(spark):
    random.seed(1)
    data = [("hot", float(random.randint(0, 5000))) for _ in range(4000)]
    data += [("same", 7.0)] * 1500 + [("same", 9.0)] * 500 + [("one", 3.0)] + [("null", None)]
    df = spark.createDataFrame(data, "g string, v double")
    percents = (0, 1, 50, 75, 90, 95, 99, 100)
    got = {(r["g"], r["pct"]): r["value"] for r in nearest_rank(df, ["g"], "v", percents, slices=8).collect()}
    for group in ("hot", "same", "one"):
        values = [v for g, v in data if g == group]
        for p in percents:
            assert got[(group, float(p))] == place(values, p), (group, p)


def test_latency_summary_and_order(spark):
    df = spark.createDataFrame([("bm25_ms", 1.0), ("bm25_ms", 3.0), ("odd", 2.0)], "phase string, ms double")
    got = {r["phase"]: r for r in latency.by_phase(df).collect()}
    assert (got["bm25_ms"]["mean"], got["bm25_ms"]["median"], got["bm25_ms"]["position"]) == (2.0, 3.0, 3)
    assert got["odd"]["stddev"] == 0.0 and got["odd"]["position"] == 12


def test_phase_shares_and_variance(spark):
    events = spark.createDataFrame([(1, {"total_ms": 10.0, "a": 4.0}), (2, {"total_ms": 0.0, "a": 50.0}), (3, {"a": 9.0})], "query_id long, phases map<string,double>")
    assert latency.phase_percentages(events).collect() == [("a", 40.0)]
    timings = spark.createDataFrame([(1, 1, "a", 2.0), (1, 2, "a", 4.0), (2, 3, "a", 9.0)], "query_id long, event long, phase string, ms double")
    got = latency.run_variance(timings).collect()
    assert [(r["query_id"], r["mean"], r["n"]) for r in got] == [(1, 3.0, 2)]


def test_running_sum_and_salted_join(spark, rows):
    df = spark.createDataFrame([("k", i, i % 7) for i in range(300)] + [("j", 5, 1)], "key string, pos long, v long")
    got = {(k, p): s for k, p, s in rows(sizing.running_sum(df, ["key"], "pos", "v", "s", block=16), "key", "pos", "s")}
    total = 0
    for i in range(300):
        total += i % 7
        assert got[("k", i)] == total
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 5)], "key long, x long")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "key long, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, big.join(small, ["key"], how).collect()))
        assert plain == sorted(map(str, sizing.lookup_join(big, small, ["key"], how, small_fits=False).collect()))
        salted = sizing.salted_join(big, small, ["key"], how, hot_rows=10, hot_share=0.05)
        assert plain == sorted(map(str, salted.collect())), how
    nulls = spark.createDataFrame([(None, i) for i in range(40)] + [(1, 1)], "key long, x long")
    spread = sizing.salted_join(nulls, small, ["key"], "left", hot_rows=10, hot_share=0.05)
    assert spread.count() == 42
    items = spark.createDataFrame([(1, "a"), (2, "b")], "key long, y string")
    for few in (True, False):
        assert sizing.items_of_hits(items, big, ["key"], few).count() == 51
    assert sizing.fits(small, 3) and not sizing.fits(small, 2)


def test_pseudonyms_are_unique_and_consistent(spark):
    a = spark.createDataFrame([(str(i),) for i in range(500)] + [(None,), (" ",), ("7 ",)], "id string")
    b = spark.createDataFrame([(i,) for i in range(400, 600)], "owner long")
    mapping = dataset.pseudonym_map([(a, "id"), (b, "owner")])
    pairs = {r["real"]: r["fake"] for r in mapping.collect()}
    assert len(pairs) == 600 == len(set(pairs.values()))
    assert all(len(f) == 8 and f.isdigit() for f in pairs.values())
    replaced = [r["id"] for r in dataset.pseudonymise(a, "id", mapping).collect()]
    assert replaced.count(pairs["7"]) == 2 and None in replaced and " " in replaced
    again = {r["real"]: r["fake"] for r in dataset.pseudonym_map([(b, "owner"), (a, "id")]).collect()}
    assert again == pairs


def test_pack_history_stops_at_first_overflow(spark, rows):
    tokens = [1, 3, 5, 4]  # oldest first
    df = spark.createDataFrame([(1, i, t, 0) for i, t in enumerate(tokens)], "chat_id long, seq long, tokens long, prompt_tokens long")
    assert rows(chat.pack_history(df, F.lit(10)), "seq") == [(2,), (3,)]


def test_sources_go_to_the_message_before(spark, rows):
    messages = spark.createDataFrame([(1, 0, "q"), (1, 1, "a"), (2, 0, "z")], "chat_id long, seq long, content string")
    cited = spark.createDataFrame([(1, 1, 1, "B"), (1, 1, 0, "A"), (1, 0, 0, "no"), (2, 1, 0, "lost")], "chat_id long, seq long, place int, content string")
    got = {(c, s): t for c, s, t in rows(chat.attach_sources_to_previous(messages, cited), "chat_id", "seq", "content")}
    assert got[(1, 0)].index("<BEGIN SOURCE>\nA") < got[(1, 0)].index("<BEGIN SOURCE>\nB")
    assert got[(1, 1)] == "a" and got[(2, 0)] == "z"


def test_chat_lists(spark, rows):
    messages = spark.createDataFrame([(1, 0, "u"), (1, 1, "v"), (2, 0, "w")], "chat_id long, seq long, content string")
    cuts = spark.createDataFrame([(1, 1)], "chat_id long, from_seq long")
    assert rows(chat.truncate_from_sequence(messages, cuts), "chat_id", "seq") == [(1, 0), (2, 0)]
    parts = spark.createDataFrame([(1, "Red Bolt"), (2, "bolt"), (3, "nut")], "id long, name string")
    chosen = spark.createDataFrame([(2,)], "id long")
    assert rows(chat.search_by_name(parts, "name", "BOLT", "id", chosen), "id") == [(1,)]
    now = F.lit("2024-03-10 08:00:00").cast("timestamp_ntz")
    stamps = ["2024-03-10 00:00:00", "2024-03-09 23:59:59", "2024-03-03 00:00:00", "2024-03-02 23:59:59"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("s"))
    got = [r[0] for r in df.select(chat.recency_bucket(F.lit(None).cast("timestamp_ntz"), F.col("s"), now)).collect()]
    assert got == ["Today", "Yesterday", "Previous Week", "Older"]


def test_visibility_follows_the_parent(spark, rows):
    chunks = spark.createDataFrame([(1, 10, "me"), (2, 10, "you"), (3, 11, "you"), (4, 12, "you")], "id long, file long, owner string")
    parents = spark.createDataFrame([(10, "private"), (11, "public")], "file long, sharing string")
    me = spark.createDataFrame([("me",)], "owner string")
    assert rows(chat.visible_rows(chunks, parents, "file", "owner", me), "id") == [(1,), (3,)]


def test_variables_without_values_stay(spark):
    prompts = spark.createDataFrame([(1, "Hi {{a}} {{b}} {{a}}"), (2, "plain")], "prompt_id long, content string")
    values = spark.createDataFrame([(1, "a", "X")], "prompt_id long, name string, value string")
    got = {r["prompt_id"]: r["content"] for r in chat.substitute_variables(prompts, values).collect()}
    assert got == {1: "Hi X {{b}} X", 2: "plain"}


def test_file_sources(spark, tmp_path, rows):
    deep = tmp_path / "docs" / "deep"
    deep.mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("one\ntwo")
    (deep / "b.MD").write_text("# x")
    (deep / "c.md").write_text("# Title\n\nbody")
    (deep / "d.bin").write_bytes(b"\x00")
    folder = str(tmp_path / "docs")
    found = files.discover_documents(spark, folder)
    assert rows(found, "file_name", "ext") == [("a.txt", ".txt"), ("b.MD", ".md"), ("c.md", ".md")]
    assert rows(files.stats_by_extension(found), "ext", "n") == [(".md", 2), (".txt", 1)]
    assert rows(files.read_text_documents(spark, folder), "file_name", "text") == [("a.txt", "one\ntwo"), ("c.md", "# Title\n\nbody")]


def test_html_and_json_text(spark):
    page = "<html><head><title> T </title><style>x</style></head><body><nav>menu</nav><h1>A <b>b</b></h1><!-- c --><p>x &amp; y&nbsp;<br>z</p><script>s()</script></body></html>"
    doc = json.dumps({"a": "x", "n": 3, "l": ["y", {"d": "z"}], "t": True})
    df = spark.createDataFrame([(page, doc), ("", "not json")], "h string, j string")
    got = df.select(
        files.html_title(F.col("h")).alias("t"),
        files.html_headings(F.col("h")).alias("hs"),
        files.html_to_text(F.col("h")).alias("x"),
        files.json_text(F.col("j")).alias("j"),
    ).collect()
    assert got[0]["t"] == "T" and got[0]["hs"] == ["A b"] and got[0]["x"] == "A b x & y z"
    assert got[0]["j"] == "x y z" and got[1]["j"] is None


def test_store_modes(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    chunks = spark.createDataFrame([(1, "s", "a", 2), (2, "t", "b", 3)], "file_id long, source string, content string, tokens long")
    assert not store.exists(spark, path)
    built = []

    def build():
        built.append(1)
        return chunks

    assert store.get_or_create(spark, path, build).count() == 2
    store.get_or_create(spark, path, build)
    assert len(built) == 1
    store.write_chunks(chunks, path)
    assert store.read_chunks(spark, path).count() == 4
    store.get_or_create(spark, path, build, force=True)
    assert store.read_chunks(spark, path).count() == 2 and len(built) == 2
    store.clear(spark, path)
    assert not store.exists(spark, path)
    with pytest.raises(ValueError):
        store.write_chunks(chunks, path, "ignore")
    incoming = spark.createDataFrame([(1, "s", "new", 9)], chunks.schema)
    assert rows(store.file_totals(store.upsert_chunks(chunks, incoming)), "file_id", "tokens") == [(1, 9), (2, 3)]


def test_trace_log(spark, tmp_path):
    folder = tmp_path / "trace"
    folder.mkdir()
    good = {"query_id": "q1", "phases": {"total_ms": 5.0}, "retrieved_docs": ["a", "b"]}
    (folder / "events.jsonl").write_text(json.dumps(good) + "\n\nbroken {\n")
    back = trace.read_trace_log(spark, str(folder)).cache()
    assert back.filter("_broken IS NOT NULL").count() == 1 and back.count() == 2
    docs = trace.retrieved_docs(back).collect()
    assert [(r["rank"], r["file_name"]) for r in docs] == [(1, "a"), (2, "b")]


def test_metadata_rules(spark):
    df = spark.createDataFrame([("Programa_206_2025-26_1.pdf",), ("other.txt",)], "f string")
    fields = md.filename_metadata(F.col("f"), [r"^(?P<kind>Programa|Proyecto)_(?P<code>\d+)", r"_(?P<year>\d{4}-\d{2})_(?P<grp>\d+)", r"(?P<kind>txt)$"])
    got = df.select(*[c.alias(n) for n, c in fields.items()]).collect()
    assert got[0].asDict() == {"kind": "Programa", "code": "206", "year": "2025-26", "grp": "1"}
    assert got[1]["kind"] == "txt" and got[1]["code"] is None
    lookup = spark.createDataFrame([(206, "Old", 1), (206, "New", 2), (3, "", 1)], "key int, value string, position int")
    chunks = spark.createDataFrame([("206",), ("3",), (None,)], "code string")
    named = {r["code"]: r["name"] for r in md.enrich_from_lookup(chunks, lookup, "code", "name").collect()}
    assert named == {"206": "New", "3": None, None: None}
    assert md.enrich_from_lookup(chunks, None, "code", "name") is chunks
    long_name = spark.createDataFrame([("Ñandú Doc (1).PDF",), ("x" * 120 + ".txt",), ("noext",)], "f string")
    safe = [r[0] for r in long_name.select(md.sanitize_file_name(F.col("f"))).collect()]
    assert safe == ["_and__doc__1_.PDF", "x" * 96 + ".txt", "noext.noext"]


def test_table_selection():
    assert tables.select_tables(["a", "b", "c"], ["a", "b"], ["b"]) == ["a"]
    assert tables.select_tables(["a", "b"], [], ["a"]) == ["b"]


def test_records_dedup(spark, rows):
    df = spark.createDataFrame([("chats", "x"), ("chats", "x"), ("chats", "y"), ("files", "x")], "contentType string, body string")
    assert rows(files.import_records(df), "contentType", "n") == [("chats", 2), ("files", 1)]


def test_stream_drops_repeats_and_late_events(spark, tmp_path, rows):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "event_key long, ts timestamp, phase string, ms double"

    def arrive(events):
        spark.createDataFrame(events, "event_key long, s string, phase string, ms double").select(
            "event_key", F.col("s").cast("timestamp").alias("ts"), "phase", "ms"
        ).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        flows.run_phase_metrics(stream, out, str(tmp_path / "cp")).awaitTermination()

    arrive([(1, "2024-01-01 00:05:00", "a", 2.0), (1, "2024-01-01 00:05:00", "a", 2.0), (2, "2024-01-01 00:06:00", "a", 4.0)])
    arrive([(3, "2024-01-01 02:00:00", "a", 1.0)])
    arrive([(4, "2024-01-01 00:07:00", "a", 100.0), (5, "2024-01-01 05:00:00", "a", 1.0)])
    got = [(str(s), n, m) for s, n, m in rows(spark.read.parquet(out), "window_start", "n", "mean")]
    assert got == [("2024-01-01 00:00:00", 2, 3.0), ("2024-01-01 02:00:00", 1, 1.0)]


def test_stream_ingest_replaces_a_file_that_arrives_again(spark, tmp_path, rows):
    source, out = tmp_path / "docs", str(tmp_path / "chunks")

    def arrive(docs):
        spark.createDataFrame(docs, "file_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("file_id long, text string").parquet(str(source))
        chunk = lambda d: d.select("file_id", F.explode(F.split("text", " ")).alias("content"))
        flows.ingest_stream(stream, chunk, out, str(tmp_path / "cp2")).awaitTermination()

    arrive([(1, "a b"), (2, "c")])
    arrive([(1, "new")])
    assert rows(flows.latest_chunks(spark, out), "file_id", "content") == [(1, "new"), (2, "c")]


TEXT_ROWS = [(1, "a\nß"), (2, ""), (10, "x"), (None, "without a key"), (1, "again"), (-3, None)]


def test_text_files_are_laid_out_as_spark_lays_them_out(spark, tmp_path):
    df = spark.createDataFrame(TEXT_ROWS, "id bigint, text string").coalesce(1)
    files.write_text_files(df, str(tmp_path / "own"), "id")
    df.write.partitionBy("id").text(str(tmp_path / "spark"))

    def contents(folder):
        found = [p for p in folder.rglob("*") if p.is_file() and p.suffix == ".txt" and p.name[0] != "."]
        return sorted((p.parent.name, sorted(p.read_bytes().split(b"\n"))) for p in found)

    assert contents(tmp_path / "own") == contents(tmp_path / "spark")
    assert not list((tmp_path / "own").rglob("_*"))


def test_text_files_of_no_rows_are_an_empty_folder(spark, tmp_path):
    files.write_text_files(spark.createDataFrame([], "id bigint, text string"), f"file://{tmp_path}/none", "id")
    assert files.discover_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_only_local_folders_are_written_by_tasks(spark):
    assert files.local_path(spark, "file:///a/b") == files.local_path(spark, "file:/a/b") == "/a/b"
    assert files.local_path(spark, "/a/b") == "/a/b"
    assert files.local_path(spark, "viewfs://store/a") is None


def test_many_files_are_found_by_few_tasks(spark, tmp_path):
    files.write_text_files(spark.range(100).selectExpr("id", "'text' AS text"), str(tmp_path / "many"), "id")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        found = files.discover_documents(spark, str(tmp_path / "many"))
        assert found.count() == 100
        assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism < 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def spark_listing(spark, folder):
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return sorted(tuple(r) for r in listed.select("path", "length").collect())


def test_tasks_list_what_the_reader_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "NAMES_AT_ONCE", 2)
    top = tmp_path / "docs"
    kept = ("a.txt", "B.Txt", "k=1/_x=2/b.txt", "k=1/c d%20é.txt", "deep/er/and/deeper/e.md", "_metadata/in.txt", "no_extension", "x.bin", "k=1/.txt.md")
    left = (".hidden.txt", "_own.txt", "_metadata.txt", "a.txt._COPYING_", ".git/f.txt", "_temporary/0/g.txt", "empty.txt")
    for name in (*kept, *left):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("" if name == "empty.txt" else name)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "l.txt").write_text("linked")
    (top / "link").symlink_to(tmp_path / "outside")
    (top / "nothing.txt").symlink_to(tmp_path / "nothing")
    (top / "none").mkdir()
    want = spark_listing(spark, str(top))
    got = files.list_files(spark, str(top), 3)
    assert sorted((f"file:{r['path'].decode()}", r["size"]) for r in got.collect()) == want
    assert len(want) == len([n for n in kept if "/." not in n]) + 1
    accepted = [(p, s) for p, s in want if p.lower().endswith((".txt", ".md"))]
    for folder in (str(top), f"{top}/", f"file://{top}"):
        found = files.discover_documents(spark, folder)
        assert sorted(tuple(r) for r in found.select("file_path", "size").collect()) == accepted
    some = files.discover_documents(spark, f"{tmp_path}/doc*", [".bin"])  # Spark's reader knows patterns
    assert [r["file_name"] for r in some.collect()] == ["x.bin"]


def test_no_list_of_files_is_in_the_driver(spark, tmp_path):
    files.write_text_files(spark.range(30).selectExpr("id", "'text' AS text"), str(tmp_path / "many"), "id")
    found = files.discover_documents(spark, str(tmp_path / "many"))
    assert found.inputFiles() == [] and found.count() == 30


def test_a_folder_that_is_not_there_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.discover_documents(spark, str(tmp_path / "nowhere"))
