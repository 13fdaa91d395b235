import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.operators import dense, fusion, lexical
from quaero.operators import retrieval_metrics as rm
from quaero.options import FusionOptions


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 8))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def frames(spark, points):
    corpus = spark.createDataFrame(
        [(i, [float(x) for x in v], i % 3) for i, v in enumerate(points)],
        "item_id long, vector array<double>, match int",
    )
    questions = corpus.filter("item_id < 40").withColumnRenamed("item_id", "query_id")
    return questions, corpus


def brute(points, k, allowed=lambda q, i: True, metric="cosine"):
    out = set()
    for q in range(40):
        scored = []
        for i in range(len(points)):
            if allowed(q, i):
                if metric == "l2":
                    s = round(float(((points[q] - points[i]) ** 2).sum()), 6)
                    scored.append((s, i))
                else:
                    scored.append((-round(float(points[q] @ points[i]), 6), i))
        for rank, (_, i) in enumerate(sorted(scored)[:k], 1):
            out.add((q, i, rank))
    return out


def as_set(df):
    return {(r["query_id"], r["item_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("sizes", [(4096, 65536), (16, 64)])
def test_exact_search_in_one_scan_and_in_blocks(frames, points, sizes):
    questions, corpus = frames
    got = dense.vector_topk(questions, corpus, 5, batch_rows=sizes[0], big_rows=sizes[1])
    assert as_set(got) == brute(points, 5)


def test_filter_before_rank_and_self_skipped(frames, points):
    questions, corpus = frames
    got = dense.vector_topk(questions, corpus, 4, matched=True, skip_self=True)
    assert as_set(got) == brute(points, 4, lambda q, i: q % 3 == i % 3 and q != i)


def test_l2_order_equals_cosine_for_unit_vectors(frames, points):
    questions, corpus = frames
    assert as_set(dense.vector_topk(questions, corpus, 3, "l2")) == brute(points, 3, metric="l2")


def test_file_items_limit_and_doubled_ids(spark, frames):
    questions, corpus = frames
    chunks = corpus.withColumn("file_id", F.col("match"))
    files = spark.createDataFrame([(1,), (1,), (2,)], "file_id int")
    one = questions.filter("query_id = 0")
    every = dense.match_file_items(one, chunks, files)
    assert every.count() == 200
    top = dense.match_file_items(one, chunks, files, 7)
    want = every.orderBy(F.desc("similarity"), "item_id").limit(7)
    assert {r["item_id"] for r in top.collect()} == {r["item_id"] for r in want.collect()}


def test_ann_recall(frames):
    questions, corpus = frames
    model = dense.train_cells(corpus, cells=10)
    found = dense.ann_topk(model, questions, dense.assign_cells(model, corpus), 10, probes=5)
    recall = dense.recall_against(dense.vector_topk(questions, corpus, 10), found)
    assert recall.agg(F.avg("recall")).first()[0] > 0.7


TEXTS = {1: "red red bolt", 2: "blue bolt nut", 3: "green gear", 4: "", 5: "Red NUT nut nut"}


def bm25_brute(question, k1=1.5, b=0.75):
    docs = {i: t.lower().split() for i, t in TEXTS.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for i, words in docs.items():
        s = 0.0
        for term in set(question.lower().split()):
            tf, df = words.count(term), sum(term in w for w in docs.values())
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                s += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / avg))
        if s:
            scores[i] = round(s, 6)
    return scores


def test_bm25_against_brute_force(spark):
    items = spark.createDataFrame(list(TEXTS.items()), "item_id long, text string")
    questions = spark.createDataFrame([(1, "red nut"), (2, "gear GEAR"), (3, "nothing")], "query_id long, text string")
    for only in (None, lexical.question_terms(questions)):
        hits = lexical.bm25_topk(questions, lexical.build_index(items, only), 10).collect()
        for q, text in ((1, "red nut"), (2, "gear GEAR"), (3, "nothing")):
            assert {r["item_id"]: r["score"] for r in hits if r["query_id"] == q} == bm25_brute(text)


def test_many_questions_take_the_salted_path(spark, monkeypatch):
    items = spark.createDataFrame(list(TEXTS.items()), "item_id long, text string")
    questions = spark.createDataFrame([(1, "red nut"), (2, "gear"), (3, "bolt")], "query_id long, text string")
    few = lexical.bm25_topk(questions, lexical.build_index(items), 10).collect()
    monkeypatch.setattr(lexical, "fits", lambda df: False)
    many = lexical.bm25_topk(questions, lexical.build_index(items), 10).collect()
    assert sorted(few) == sorted(many)


def test_index_round_trip(spark, tmp_path):
    items = spark.createDataFrame(list(TEXTS.items()), "item_id long, text string")
    questions = spark.createDataFrame([(1, "red nut")], "query_id long, text string")
    built = lexical.build_index(items)
    built.write(str(tmp_path / "index"), partitions=4)
    read = lexical.LexicalIndex.read(spark, str(tmp_path / "index"))
    assert sorted(lexical.bm25_topk(questions, read, 5).collect()) == sorted(
        lexical.bm25_topk(questions, built, 5).collect()
    )


def ranked(spark, lists):
    return [
        spark.createDataFrame(
            [(1, item, 1.0 - i / 10, i + 1) for i, item in enumerate(items)],
            "query_id long, item_id long, score double, rank long",
        )
        for items in lists
    ]


def test_fusion_hand_case(spark):
    dense_list, lexical_list = ranked(spark, [[1, 2], [2, 3]])
    got = fusion.rrf_fuse([(dense_list, 0.5), (lexical_list, 0.5)]).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == [2, 1, 3]
    assert got[0]["score"] == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-9)


def test_fusion_ties_and_input_order(spark):
    dense_list, lexical_list = ranked(spark, [[1, 2, 3], [9, 8, 7]])
    got = [r["item_id"] for r in fusion.rrf_fuse([(dense_list, 0.5), (lexical_list, 0.5)]).orderBy("rank").collect()]
    assert got == [1, 9, 2, 8, 3, 7]
    shuffled = fusion.rrf_fuse([(dense_list.orderBy(F.rand(1)), 0.5), (lexical_list.repartition(3), 0.5)])
    assert [r["item_id"] for r in shuffled.orderBy("rank").collect()] == got


def test_modes_do_not_plan_the_unused_list(spark):
    dense_list, lexical_list = ranked(spark, [[1, 2], [2, 3]])

    def never(k):
        raise AssertionError("must not be built")

    assert fusion.retrieve("semantic", lambda k: dense_list, never).count() == 2
    assert fusion.retrieve("bm25", never, lambda k: lexical_list).count() == 2
    assert fusion.retrieve("hybrid", lambda k: dense_list, None).count() == 2
    assert fusion.retrieve("hybrid", lambda k: dense_list, lambda k: lexical_list, FusionOptions(top_k=1)).count() == 1


def test_rerank_and_failed_scorer(spark, rows):
    (hits,) = ranked(spark, [[3, 1, 2]])
    questions = spark.createDataFrame([(1, "red nut")], "query_id long, text string")
    items = spark.createDataFrame(list(TEXTS.items()), "item_id long, text string")
    assert rows(fusion.rerank_topn(hits, questions, items, 2), "rank", "item_id") == [(1, 1), (2, 2)]
    broken = fusion.rerank_topn(hits, questions, items, 2, lambda q, p: F.lit(None).cast("double"))
    assert rows(broken, "rank", "item_id") == [(1, 3), (2, 1)]


def test_boost_moves_negative_scores_down(spark, rows):
    hits = spark.createDataFrame(
        [(1, 1, 0.6, 1), (1, 2, 0.5, 2), (1, 3, -0.1, 3), (1, 4, -0.12, 4)],
        "query_id long, item_id long, score double, rank long",
    )
    items = spark.createDataFrame([(1, "x"), (2, "Guía"), (3, "guia"), (4, "x")], "item_id long, field string")
    wanted = spark.createDataFrame([(1, "GUÍA")], "query_id long, boost_value string")
    got = fusion.apply_metadata_boost(hits, items, wanted)
    assert rows(got, "rank", "item_id") == [(1, 2), (2, 1), (3, 4), (4, 3)]


def test_dedupe_keeps_first_arrival(spark, rows):
    first, second = ranked(spark, [[1, 2], [2, 3]])
    got = fusion.dedupe_hits([first, second])
    assert rows(got, "rank", "item_id", "score") == [(1, 1, 1.0), (2, 2, 0.9), (3, 3, 0.9)]


def judged(spark, flags):
    return spark.createDataFrame(
        [(q, rank, bool(f)) for q, fs in flags.items() for rank, f in enumerate(fs, 1)],
        "query_id long, rank long, relevant boolean",
    )


def test_metric_hand_cases(spark):
    got = rm.per_query(judged(spark, {1: [0, 1, 1], 2: [0, 0, 0], 3: [1]}), [3]).collect()
    by = {r["query_id"]: r for r in got}
    assert by[1]["ndcg"] == pytest.approx(0.6934, abs=1e-4)
    assert by[1]["rr"] == 0.5 and by[1]["precision"] == pytest.approx(2 / 3)
    assert (by[2]["hit"], by[2]["rr"], by[2]["precision"], by[2]["ndcg"]) == (0, 0, 0, 0)
    assert by[3]["precision"] == 1.0 and by[3]["ndcg"] == 1.0


def test_metric_bounds_on_random_lists(spark):
    random.seed(3)
    flags = {q: [random.random() < 0.3 for _ in range(10)] for q in range(50)}
    for r in rm.per_query(judged(spark, flags), [1, 3, 5, 10]).collect():
        assert 0 <= r["ndcg"] <= 1 + 1e-12 and r["hit"] >= r["rr"] >= 0 and r["precision"] <= 1


def test_judge_ignores_case(spark):
    df = spark.createDataFrame([("L3_7.txt",), ("L13_7.txt",)], "f string")
    got = [r["relevant"] for r in rm.judge(df, F.col("f"), F.lit("^l3_")).collect()]
    assert got == [True, False]


def test_recovered_lost_and_rank_shift(spark, rows):
    base = spark.createDataFrame([(1,), (2,)], "query_id long")
    full = spark.createDataFrame([(2,), (3,)], "query_id long")
    assert rows(rm.recovered_lost(base, full), "query_id", "change") == [(1, "recovered"), (3, "lost")]
    without = judged(spark, {1: [0, 0, 1], 2: [0, 0], 3: [1, 0], 4: [0, 1], 5: [0]})
    with_filter = judged(spark, {1: [1, 0, 0], 2: [0, 1], 3: [0, 0], 4: [0, 1], 5: [0]})
    got = rows(rm.rank_shift(without, with_filter), "query_id", "outcome")
    assert got == [(1, "improved"), (2, "recovered"), (3, "lost"), (4, "same"), (5, "both_miss")]


def test_coverage(spark):
    df = spark.createDataFrame(
        [(1, ["bolt", "nut", "gear"], "A Bolt"), (1, ["bolt", "nut", "gear"], "bolt NUT"), (2, ["x"], "none")],
        "query_id long, keywords array<string>, text string",
    )
    got = {r["query_id"]: r["coverage"] for r in fusion.keyword_coverage(df).collect()}
    assert got == {1: pytest.approx(2 / 3, abs=1e-6), 2: 0.0}


def test_few_questions_shuffle_only_the_best_hits_of_a_task(spark):
    from quaero.operators import lexical

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(2)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), rng.choice(["x", "y", None])) for i in range(300)]
    rows += [rows[7], (11, "aa bb cc", "x"), (None, "aa bb dd", "x"), (None, "aa bb dd", "y"), (400, None, "x")]
    items = spark.createDataFrame(rows, "item_id long, text string, match string").repartition(3)
    asked = [(q, " ".join(rng.choice(words) for _ in range(6)), rng.choice(["x", None])) for q in range(9)]
    questions = spark.createDataFrame([*asked, asked[0], (None, "aa bb", "x")], "query_id long, text string, match string")
    built = lexical.build_index(items)
    from_postings = lexical.LexicalIndex(built.postings, built.terms, built.stats)
    for matched in (False, True):
        got = lexical.bm25_topk(questions, built, 5, matched=matched)
        want = lexical.bm25_topk(questions, from_postings, 5, matched=matched).collect()
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
    once = lexical.build_index(spark.createDataFrame(rows[:300], items.schema))
    plan = lexical.bm25_topk(questions, once, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" in plan


def test_a_task_scores_few_items_at_once(spark, monkeypatch):
    from quaero.operators import dense

    sizes = []
    kernel = dense._kernel("cosine", 2, False, False)
    real = dense.np.lexsort
    monkeypatch.setattr(dense.np, "lexsort", lambda keys, axis=-1: sizes.append(keys[0].shape) or real(keys, axis=axis))
    import numpy as np
    import pandas as pd

    corpus = pd.DataFrame({"item_id": range(5000), "vector": [np.array([float(i), 1.0]) for i in range(5000)]})
    asked = pd.DataFrame({"query_id": [1, 2], "vector": [np.array([1.0, 0.0]), np.array([-1.0, 0.0])]})
    (found,) = kernel(iter([corpus]), asked)
    assert found["item_id"].tolist() == [4999, 4998, 0, 1]
    assert max(n for _, n in sizes) <= 1024 + 2
