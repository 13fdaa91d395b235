"""Tokenizer alignment, quality classifier and fill-in-middle against plain versions of each."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaero.llm import fill_in_middle as fim
from quaero.llm import quality_classifier as qc
from quaero.llm import queries
from quaero.llm import tokenizer_alignment as ta

BYTES, PIECES = (public_tokenizers.path(n) for n in (queries.BYTE_BPE, queries.PIECE_BPE))

TRICKY = [
    "plain words, some of them repeated; some of them not.",
    "a <|endoftext|> b <s> c </s> d <unk>",
    "▁ already there",
    " leading and trailing  blanks   ",
    "tabs\tand\nlines\n\n",
    "日本語 🙂 ß É́ ​\u0000x",
    "x",
    " ",
    "",
]


# -- tokenizer alignment


@pytest.fixture(scope="module")
def tokenizers():
    a, b = ta.ByteLevel(BYTES), ta.Pieces(PIECES)
    return a, b, ta.Spelling(a.spelled()), ta.Spelling(b.spelled())


def plain_tokens(tokenizers, text):
    """Ids and byte ends of both sides, one token at a time; None where a side doesn't spell the text."""
    a, b, spell_a, spell_b = tokenizers
    if not text:
        return None
    sides = []
    for ids, spelling in ((a.encode([text])[0], spell_a), (b.encode([text])[0], spell_b)):
        spelled = [spelling.tokens[i].as_py() for i in ids]
        if b"".join(spelled) != f" {text}".encode():
            return None
        sides.append((ids, np.cumsum([len(x) for x in spelled]).tolist()))
    return sides


def plain_groups(sides):
    (a, ends_a), (b, ends_b) = sides
    met = sorted(set(ends_a) & set(ends_b))
    groups, i, j = [], 0, 0
    for e in met:
        k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def brute_force(tokenizers, texts):
    found, counts = [], Counter()
    for t in texts:
        sides = plain_tokens(tokenizers, t or "")
        groups = plain_groups(sides) if sides else []
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        found.append((sides, groups, links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for sides, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append(
            (
                len(sides[0][0]) if sides else 0,
                len(sides[1][0]) if sides else 0,
                len(groups),
                len(links),
                sum(counts[p] == most[p[1]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if sides else "",
            )
        )
    return rows


COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("common", [1 << 16, 3, 0])
def test_alignment_is_that_of_plain_loops(spark, documents, tokenizers, common):
    texts = [r["text"] for r in documents.select("text").limit(25).collect()]
    texts = [t and t[:1500] for t in texts] + TRICKY + [None, TRICKY[0], TRICKY[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    aligned = ta.align(df, BYTES, PIECES)
    got = {r["doc_id"]: tuple(r[c] for c in COUNTED) for r in ta.link_scores(aligned, common=common).collect()}
    want = brute_force(tokenizers, texts)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(r[2] > 3 for r in want) > 20


def test_alignment_keeps_ids_and_group_sizes(spark, tokenizers):
    df = spark.createDataFrame([(1, TRICKY[0]), (2, TRICKY[2])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ta.align(df, BYTES, PIECES).collect()}
    groups = plain_groups(plain_tokens(tokenizers, TRICKY[0]))
    assert rows[1]["a"] == [x for g, _ in groups for x in g] and rows[1]["b_sizes"] == [len(g) for _, g in groups]
    assert rows[2]["a"] == rows[2]["b"] == rows[2]["a_sizes"] == []  # U+2581 is no blank


def test_long_texts_are_cut_where_both_tokenizers_begin_a_token(tokenizers):
    rng = random.Random(3)
    parts = ["word", "Zürich", " ", "  ", "\n", "12", "日本", "don't", "…", "a", " ", " b ", "\t", "🙂"]
    for _ in range(60):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", " "]) for _ in range(200))
        for tokenizer in tokenizers[:2]:
            whole = ta.token_lists(tokenizer, [text], 1 << 20).to_pylist()
            assert ta.token_lists(tokenizer, [text], 40).to_pylist() == whole
    assert tokenizers[0].cuts and tokenizers[1].cuts


def test_ranks_give_the_tokens_of_the_library(tokenizers, documents):
    a = tokenizers[0]
    assert a.ranked is not None
    every = [chr(c) for c in range(0x0, 0x2060) if ta._OLD_SCRIPTS.fullmatch(chr(c))]
    rng = random.Random(11)
    texts = ["".join(rng.choice(every) for _ in range(80)) for _ in range(400)]
    texts += [f"x{c}{c}1 {c} {c}a{c}\n{c}  {c}" for c in every]
    texts += [r["text"] for r in documents.select("text").collect() if r["text"]]
    library = a.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
    assert [np.asarray(x).tolist() for x in a.encode(texts)] == [e.ids for e in library]


def test_alignment_of_odd_rows(odd, none):
    rows = ta.link_scores(ta.align(odd, BYTES, PIECES)).collect()
    assert len(rows) == odd.count()
    assert sorted(r["n_a"] == 0 for r in rows) == sorted(t is None or t == "" for t in [r["text"] for r in odd.collect()])
    assert all((r["n_a"] == 0) == (r["groups_sha256"] == "") and r["n_best"] <= r["n_links"] <= r["count_sum"] for r in rows)
    assert ta.link_scores(ta.align(none, BYTES, PIECES)).collect() == []


# -- quality classifier


def test_word_table_is_the_sum_of_random_rows_of_neighbours():
    texts = ["one two three one", "", "two", "*** one ***two"]
    rows = qc.random_rows()
    table = np.zeros((qc.BUCKETS, qc.WIDTH), dtype=np.int64)
    for words, cuts in qc.words_of(texts):
        qc.add_company(table, words, cuts, rows)
    want = np.zeros_like(table)
    random_row = np.zeros((qc.BUCKETS, qc.WIDTH), dtype=np.int64)
    for j in range(qc.NONZERO):
        np.add.at(random_row, (np.arange(qc.BUCKETS), rows[0][:, j]), rows[1][:, j])
    for t in texts:
        own = [w for w, _ in qc.words_of([t])]
        own = own[0].tolist() if own else []
        assert len(own) == len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", t))
        for i, w in enumerate(own):
            for k in range(max(0, i - qc.REACH), min(len(own), i + qc.REACH + 1)):
                if k != i:
                    want[w] += random_row[own[k]]
    assert (table == want).all() and table.any()


def test_word_table_over_partitions(spark, documents):
    df = documents.select(F.coalesce("text", F.lit("")).alias("_text"))
    one, many = qc.company(df.coalesce(1)), qc.company(df.repartition(5))
    assert (one == many).all() and one.any()


def test_pooling_of_short_and_long_texts():
    rng = np.random.default_rng(1)
    vectors = qc.word_vectors(rng.normal(size=(qc.BUCKETS, qc.WIDTH)))
    sizes = [0, 1, 2, 40_000, 0, 100, 70_000]
    words = rng.integers(0, qc.BUCKETS, sum(sizes))
    cuts = np.r_[0, np.cumsum(sizes)]
    got = qc.pooled(words, cuts, vectors)
    for k, n in enumerate(sizes):
        v = vectors[words[cuts[k] : cuts[k + 1]]].astype(np.float64)
        want = [v.mean(0), (v * v).mean(0), (v[:-1] * v[1:]).sum(0) / max(n - 1, 1)] if n else [np.zeros(qc.WIDTH)] * 3
        assert np.allclose(got[k], np.hstack(want), atol=1e-4)


def test_temperature_makes_scores_as_sure_as_they_are_right():
    rng = np.random.default_rng(2)
    truth = 1 / (1 + np.exp(-rng.normal(0, 1.5, 20_000)))
    labels = (rng.random(20_000) < truth).astype(int)
    logits = 4 * np.log(truth / (1 - truth))  # four times too sure
    assert 3.5 < qc.temperature(logits, labels) < 4.5


def test_held_out_documents_get_the_right_label(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = qc.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    wrong = (rows["predicted"] != rows["quality"]).mean()
    good, bad = (rows.loc[rows["quality"] == k, "score"].to_numpy() for k in (1, 0))
    ranked = (good[:, None] > bad[None, :]).mean()
    assert len(rows) > 50 and len(bad) > 5
    assert wrong <= 0.05 and ranked >= 0.97
    assert abs(rows["score"].mean() - rows["quality"].mean()) < 0.08


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(1, 11)] + [(None, 1), (3, None), (4, 7), (4, 1)], "doc_id long, quality int"
    )
    rows = qc.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    empty = [r["score"] for r in rows if r["doc_id"] in (2, 3, 4)]
    assert len(empty) == 3 and empty == pytest.approx([empty[0]] * 3)
    assert qc.score_quality(none, labels).collect() == []
    assert {r["score"] for r in qc.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in qc.score_quality(odd, labels.where("quality = 1")).collect()} == {0.5}


def test_labels_of_held_out_documents_change_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(qc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [
        {r["doc_id"]: r["score"] for r in qc.score_quality(documents, x).collect()} for x in (labels, turned)
    ]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


# -- fill in the middle


def plain_middle(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


def test_exception_index_converts_every_cut():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab\nßé日🙂߿ࠀ￿") for _ in range(rng.randrange(30)))
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        index = fim.ExceptionIndex(raw)
        cuts = np.arange(len(text) + 1)
        want = [len(text[:k].encode()) for k in cuts]
        assert index.bytes(cuts).tolist() == want and index.chars(np.array(want)).tolist() == cuts.tolist()
        assert index.length == len(text)
    assert len(fim.ExceptionIndex(np.frombuffer(b"ascii only", dtype=np.uint8)).at_byte) == 0


@pytest.mark.parametrize("options", [{}, {"unit": "char"}, {"rate": 40, "spm": 20, "seed": 3}])
def test_fill_in_middle_is_that_of_plain_slices(spark, odd, options):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab\n\r ß日🙂<>PSM") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["<P>", "x<S>y", "<<M>>", "<P", "S>x\n<", "\n", "\n\n", "a\r\nb", "no end", " a \n"]
    some = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    df = some.unionByName(odd.select("doc_id", "text"))
    made = fim.fill_in_middle(df, **options).withColumn("again", fim.restored())
    got = sorted((repr(tuple(r)) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again").collect()))
    want = sorted(repr((r["doc_id"], *plain_middle(r["doc_id"], r["text"], **options), r["text"] or "")) for r in df.collect())
    assert got == want
    assert {"psm", "spm", "plain"} == {r["form"] for r in made.select("form").distinct().collect()}


def test_fill_in_middle_of_nothing_and_of_unknown_units(none):
    assert fim.fill_in_middle(none).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(none, unit="word")


def test_long_text_is_cut_in_linear_time(spark):
    df = spark.createDataFrame([(1, "zeile ß\n" * 400_000)], "doc_id long, text string")
    row = fim.fill_in_middle(df).withColumn("again", fim.restored()).first()
    assert row["n"] == 400_000 and row["again"] == "zeile ß\n" * 400_000
