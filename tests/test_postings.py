"""The stored block index: equal to scoring every item, with whole folders and ranges left unread."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.operators import lexical, postings
from quaero.options import Bm25Options


def corpus(n, seed, topics=6):
    """Items in order of topic, so that the ranges of a task differ in what they hold."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        topic = i * topics // n
        words = [f"t{topic}w{int(rng.expovariate(0.3))}" if rng.random() < 0.6 else f"c{int(rng.expovariate(0.5))}" for _ in range(rng.randrange(1, 40))]
        out.append((i * 3 + 1, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def items(spark):
    rows = [*corpus(600, 1), (10_000, None), (10_001, ""), (10_002, "c0 c0 t1w0"), (10_003, "c0 c0 t1w0")]
    return spark.createDataFrame(rows, "item_id long, text string").coalesce(2)


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(2)
    rows = [(q, " ".join(rng.choice([f"t{q % 6}w{rng.randrange(6)}", f"c{rng.randrange(5)}"]) for _ in range(5))) for q in range(25)]
    rows += [(90, "nowhere to be found"), (91, ""), (92, None), (93, "C0 c0; t1W0!")]
    return spark.createDataFrame(rows, "query_id long, text string")


@pytest.fixture(scope="module")
def index(spark, items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "blocks")
    postings.write_index(items, path, buckets=16, range_rows=20)
    return postings.BlockIndex(spark, path, 16)


def listed(df):
    return sorted(tuple(r) for r in df.select("query_id", "item_id", "score", "rank").collect())


@pytest.mark.parametrize("options", [Bm25Options(), Bm25Options(k1=0.6, b=0.2), Bm25Options(k1=0.0, b=1.0)])
@pytest.mark.parametrize("k", [1, 7])
def test_stored_search_is_that_of_all_items(items, questions, index, options, k):
    every = lexical.bm25_topk(questions, lexical.build_index(items), k, options)
    assert listed(postings.Search(index, questions, k, options).run()) == listed(every)
    assert len({r[0] for r in listed(every)}) == 26


def test_ranges_that_cannot_reach_the_best_are_left_out(questions, index):
    bounds, first, rest, _ = postings.Search(index, questions, 3).steps()
    assert first.count() + rest.count() < 0.7 * bounds.count()
    assert rest.join(first, ["query_id", "range"]).count() == 0


def test_no_bound_is_below_a_score(items, questions, index):
    search = postings.Search(index, questions, 700)
    bounds, *_ = search.steps()
    where = index.blocks([postings.STATS, *range(16)]).where("term is not null").select("range", F.explode("items").alias("item_id")).distinct()
    met = search.run().join(where, "item_id").join(bounds, ["query_id", "range"])
    assert met.count() > 500 and met.where("score > bound + 1e-6").count() == 0


def test_other_buckets_are_not_read(spark, index):
    one = spark.createDataFrame([(1, "t1w0")], "query_id long, text string")
    asked = one.select(postings.term_bucket(F.lit("t1w0"), 16).alias("b")).first()["b"]
    plan = index.blocks([asked])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = %d\)\]" % asked, plan)
    assert postings.Search(index, one, 3).run().count() == 3


def test_further_items_are_appended(spark, items, questions, tmp_path):
    path = str(tmp_path / "blocks")
    first, second = items.where("item_id <= 900"), items.where("item_id > 900")
    postings.write_index(first, path, buckets=8, range_rows=50)
    postings.write_index(second, path, buckets=8, range_rows=50, append=True)
    got = postings.Search(postings.BlockIndex(spark, path, 8), questions, 5).run()
    assert listed(got) == listed(lexical.bm25_topk(questions, lexical.build_index(items), 5))


def test_many_questions_take_the_shuffled_way(items, questions, index, monkeypatch):
    want = listed(postings.Search(index, questions, 4).run())
    monkeypatch.setattr(postings, "fits", lambda df: False)
    assert listed(postings.Search(index, questions, 4).run()) == want


def test_an_empty_corpus_has_no_hits(spark, questions, items, tmp_path):
    postings.write_index(items.limit(0), str(tmp_path / "none"))
    index = postings.BlockIndex(spark, str(tmp_path / "none"))
    assert index.spark.read.schema("bucket int").parquet(index.path).count() == 0


@pytest.mark.parametrize("at_once", [1, 2, 100])
def test_numbers_are_packed_as_bytes_and_read_again(monkeypatch, at_once):
    monkeypatch.setattr(postings, "PACKED_AT_ONCE", at_once)
    first, second = np.array([0, 127, 16_383, 2**31, 5]), np.array([1, 128, 16_384, 2**40, 0])
    offsets = np.array([0, 0, 2, 2, 4, 5, 5])
    lists = postings.packed((first, second), offsets)
    both = np.column_stack([first, second]).ravel()
    for part, start in ((lists, 0), (lists.slice(2), 2), (lists.slice(5), 5)):
        got, at = postings.unpacked(part)
        assert got.tolist() == both[2 * offsets[start] :].tolist() and at.tolist() == (2 * (offsets[start:] - offsets[start])).tolist()
    assert [len(x) for x in lists.to_pylist()] == [0, 1 + 1 + 1 + 2, 0, 2 + 3 + 5 + 6, 1 + 1, 0]


def test_a_range_hands_on_the_best_of_a_question_only(spark, items, questions, index, monkeypatch):
    sizes, top = [], postings.Search._top

    def spied(self, scored):
        sizes.append(scored.count())
        return top(self, scored)

    monkeypatch.setattr(postings.Search, "_top", spied)
    bounds, first, rest, hits = postings.Search(index, questions, 2).steps()
    monkeypatch.undo()
    # before, every item with a term of the question was handed on
    assert sizes[0] <= 2 * first.count() and sizes[1] <= 2 * (first.count() + rest.count())
    assert listed(hits) == listed(lexical.bm25_topk(questions, lexical.build_index(items), 2))


def test_rows_of_one_id_in_a_range_add_up(spark, tmp_path):
    path, rows = str(tmp_path / "blocks"), [(-5, "a b"), (2**62, "a c c"), (-5, "a a d"), (7, "b")]
    postings.write_index(spark.createDataFrame(rows, "item_id long, text string").coalesce(1), path, buckets=2)
    asked = spark.createDataFrame([("x", "a b"), ("x", "a"), ("y", "c"), (None, "a")], "query_id string, text string")
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    w = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2.25))
    a, b = 2 * idf(3), idf(2)  # the question that is there twice asks for a twice
    want = [("x", -5, a * (w(1, 2) + w(2, 3)) + b * w(1, 2)), ("x", 2**62, a * w(1, 3)), ("x", 7, b * w(1, 1)), ("y", 2**62, idf(1) * w(2, 3))]
    want = [(q, i, pytest.approx(s, abs=1e-6)) for q, i, s in sorted(want)]
    got = sorted(tuple(r)[:3] for r in postings.Search(postings.BlockIndex(spark, path, 2), asked, 3).run().collect())
    assert got == want


def test_the_questions_of_a_range_are_dealt_out(items, questions, index, monkeypatch):
    want = listed(postings.Search(index, questions, 4).run())
    monkeypatch.setattr(postings, "ASKS_AT_ONCE", 7)
    monkeypatch.setattr(postings, "ROWS_OUT", 3)
    assert listed(postings.Search(index, questions, 4).run()) == want
