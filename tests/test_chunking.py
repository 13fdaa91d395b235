import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaero.operators import chunking as ch
from quaero.options import ChunkOptions

texts = st.text(alphabet="ab .!?\n\t#é", min_size=0, max_size=400)


def sentence_spans(text, size, overlap):
    return ch._pack(ch._sentence_pieces(text, size), size, overlap)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(5, 60), st.integers(0, 4))
def test_sentence_chunks_cover_text_within_size(text, size, overlap):
    spans = sentence_spans(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(spans, spans[1:]))


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks_cover_words_within_size(text, size, overlap):
    spans = ch._trimmed(text, ch._recursive(text, (0, len(text)), ch.TEXT_SEPARATORS, size, overlap))
    assert all(0 < b - a <= size for a, b in spans)
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def test_overlap_repeats_last_sentences():
    text = "Aaaa. Bbbb. Cccc. Dddd."
    spans = sentence_spans(text, 12, 6)
    assert [text[a:b] for a, b in spans] == ["Aaaa. Bbbb. ", "Bbbb. Cccc. ", "Cccc. Dddd."]


def test_recursive_without_separator_is_the_window_form(spark, rows):
    docs = spark.createDataFrame([(1, "x" * 9000), (2, "short"), (3, "")], "id long, text string")
    windows = rows(ch.chunk_char_windows(docs), "id", "chunk_index", "content")
    recursive = rows(ch.chunk_recursive(docs), "id", "chunk_index", "content")
    assert windows == recursive
    assert [len(c) for i, _, c in windows if i == 1] == [4000, 4000, 1400]


def test_rows_are_only_split_at_blank_lines(spark, rows):
    text = "\n\n".join(f"row: {i}\nvalue: {'v' * 30}" for i in range(10))
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    got = [c for _, c in rows(ch.chunk_recursive(docs, 100, 0, ch.ROW_SEPARATORS), "chunk_index", "content")]
    assert all(re.match("row: ", c) for c in got) and sum(c.count("row:") for c in got) == 10
    long_row = spark.createDataFrame([(1, "y" * 500)], "id long, text string")
    assert ch.chunk_recursive(long_row, 100, 0, ch.ROW_SEPARATORS).count() == 1


def test_structure_and_resplit_inherit_columns(spark, rows):
    page = "intro <h1>Title</h1> body <h2>Sub</h2> " + "Long sentence here. " * 40
    docs = spark.createDataFrame([(7, "f.html", page)], "id long, file string, text string")
    sections = ch.chunk_by_structure(docs, "<h[1-6]>")
    assert [c[:4] for _, c in rows(sections, "chunk_index", "content")] == ["intr", "<h1>", "<h2>"]
    options = ChunkOptions(size=32, overlap=0)
    parts = ch.resplit_oversized(sections, options)
    assert parts.filter("file <> 'f.html'").count() == 0
    assert parts.filter("chunk_index < 2 AND part > 0").count() == 0
    assert parts.filter("chunk_index = 2").count() > 1
    assert parts.filter(F.col("tokens") > options.max_tokens).count() == 0


def heading(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(ch.extract_heading(F.col("t")).alias("h")).first()["h"]


def test_heading_block(spark):
    assert heading(spark, "# A\n\n## B\ntext\n# C") == "B"
    assert heading(spark, "before\n### Only\n\nafter") == "Only"
    assert heading(spark, "no heading\n#hash") == ""
    assert heading(spark, "\n" .join(["line"] * 20 + ["# late"])) == ""


def test_parts_are_packed_like_the_whole_document(spark):
    from quaero.operators import packing

    rng = random.Random(8)

    def sentence():
        n = rng.choice([1, 3, 8, 20, 60])
        return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9 if n < 60 else 90))) for _ in range(n)) + rng.choice([".", "!", "?", "..."])

    docs = {}
    for k, n in enumerate([0, 1, 2, 7, 60, 300]):
        docs[k] = ["".join(sentence() + rng.choice([" ", "\n"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    docs[9] = ["", "x" * 700 + ".", None, "One. Two.", "\n\n", "Three."]
    rows = [(k, i, t) for k, parts in docs.items() for i, t in enumerate(parts)]
    for options in (ChunkOptions(size=32, overlap=8), ChunkOptions(size=16, overlap=0), ChunkOptions(size=64, overlap=50)):
        parts = spark.createDataFrame(rows, "doc_id long, part int, text string").repartition(5)
        got = sorted(tuple(r) for r in packing.chunk_parts(parts, options).collect())
        whole = spark.createDataFrame([(k, "".join(p or "" for p in ps)) for k, ps in docs.items()], "doc_id long, text string")
        want = ch.chunk_fixed(whole, options).select("doc_id", "chunk_index", "content", "tokens")
        assert got == sorted(tuple(r) for r in want.collect())
        assert len(got) > 100


def test_short_documents_in_parts_need_no_pointers(spark, monkeypatch):
    from quaero.operators import packing

    rows = [(k, i, f"Sentence {i} of text {k}. " * 3) for k in range(4) for i in range(30)] + [(None, 0, "Nobody's.")]
    parts = spark.createDataFrame(rows, "doc_id long, part int, text string").repartition(3)
    options = ChunkOptions(size=32, overlap=8)
    by_pointers = sorted(map(tuple, packing.chunk_parts(parts, options, whole_chars=0).collect()))
    both = sorted(map(tuple, packing.chunk_parts(parts.unionByName(parts.filter("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.repeat("text", 9))), options, whole_chars=3000).filter("doc_id <> 9").collect()))
    monkeypatch.setattr(packing, "reached", None)
    alone = sorted(map(tuple, packing.chunk_parts(parts, options).collect()))
    assert alone == by_pointers == both and len(alone) > 40


def test_spans_stay_numbers_in_a_task(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, "é😀. x")], "doc_id long, text string")
    spans = docs.select("doc_id", ch.spans_of(lambda t: ch._sentence_pieces(t, 100), F.col("text")).alias("s"))
    assert {r.doc_id: [tuple(s) for s in r.s] for r in spans.collect()} == {1: [(0, 5), (5, 9)], 2: [], 3: [], 4: [(0, 4), (4, 5)]}
    assert "ArrowEvalPython" in spans._jdf.queryExecution().executedPlan().toString()
