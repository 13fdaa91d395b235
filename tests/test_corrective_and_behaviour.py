import pytest
from pyspark.sql import functions as F

from quaero.operators import behaviour as bh
from quaero.operators import corrective as co
from quaero.options import CorrectiveOptions


@pytest.mark.parametrize(
    "response, grade",
    [
        ("RELEVANT", "RELEVANT"),
        ("  relevante.", "RELEVANT"),
        ("El documento es IRRELEVANT", "IRRELEVANT"),
        ("no relevante", "IRRELEVANT"),
        ("No es relevante", "RELEVANT"),
        ("ambiguo", "AMBIGUOUS"),
        ("no es relev.", "IRRELEVANT"),
        ("muy útil", "RELEVANT"),
        ("sin  relevancia", "IRRELEVANT"),
        ("no sé", "AMBIGUOUS"),
        ("", "AMBIGUOUS"),
        (None, "AMBIGUOUS"),
    ],
)
def test_grades(spark, response, grade):
    df = spark.createDataFrame([(response,)], "r string")
    assert df.select(co.parse_grade(F.col("r")).alias("g")).first()["g"] == grade


@pytest.mark.parametrize(
    "response, want",
    [
        ('"mejor pregunta"', "mejor pregunta"),
        ("  'otra forma' ", "otra forma"),
        ("abc", "original"),
        ("", "original"),
        (None, "original"),
    ],
)
def test_rewrites(spark, response, want):
    df = spark.createDataFrame([("original", response)], "o string, r string")
    assert df.select(co.clean_rewrite(F.col("o"), F.col("r")).alias("x")).first()["x"] == want


def test_prompt_is_cut_and_marked(spark):
    df = spark.createDataFrame([("q", "x" * 30), ("q", "x" * 10)], "question string, passage string")
    got = [r["prompt"] for r in co.grade_prompts(df, CorrectiveOptions(max_document_chars=20)).collect()]
    assert "x" * 20 + "..." in got[0] and "x" * 21 not in got[0] and "..." not in got[1]


def test_model_failures_give_null_and_recorded_answers_are_joined(spark):
    df = spark.createDataFrame([("p1",), ("p2",)], "prompt string").coalesce(1)

    def broken(batch):
        raise RuntimeError("no model")

    assert [r["response"] for r in co.ask_model(df, broken).collect()] == [None, None]
    assert sorted(r["response"] for r in co.ask_model(df, lambda b: b.str.upper()).collect()) == ["P1", "P2"]
    recorded = df.filter("prompt = 'p1'").select(F.sha2("prompt", 256).alias("prompt_hash"), F.lit("yes").alias("response"))
    got = {r["prompt"]: r["response"] for r in co.recorded_responses(df, recorded).collect()}
    assert got == {"p1": "yes", "p2": None}


def graded(spark, grades):
    return spark.createDataFrame(
        [(q, item, rank, g) for q, gs in grades.items() for rank, (item, g) in enumerate(gs, 1)],
        "query_id long, item_id long, rank long, grade string",
    )


R, I, A = "RELEVANT", "IRRELEVANT", "AMBIGUOUS"


def test_ratio_and_trigger(spark):
    first = graded(spark, {1: [(i, R) for i in range(7)] + [(7, I), (8, I), (9, A)], 2: [(1, R), (2, A), (3, A)]})
    counts = co.grade_counts(first)
    flagged = counts.withColumn("rewrite", co.needs_rewrite(counts))
    got = {r["query_id"]: (r["relevance_ratio"], r["rewrite"]) for r in flagged.collect()}
    assert got[1] == (pytest.approx(0.7), False) and got[2][1] is True
    never = counts.withColumn("rewrite", co.needs_rewrite(counts, CorrectiveOptions(rewrite=False)))
    assert never.filter("rewrite").count() == 0
    assert co.keep_graded(first).filter("query_id = 1").count() == 8


def test_filter_counts_each_grade(spark):
    hits = graded(spark, {1: [(1, R), (2, I), (3, A), (4, R), (4, R)], 2: [(5, I), (6, I)], 3: [(7, A)], None: [(8, I), (9, R)]})
    got = sorted((tuple(r) for r in co.keep_graded(hits, counted=True).collect()), key=str)
    assert got == sorted(
        [(1, 1, 1, R, 3, 1, 1), (1, 3, 3, A, 3, 1, 1), (1, 4, 4, R, 3, 1, 1), (1, 4, 5, R, 3, 1, 1),
         (2, None, None, None, 0, 2, 0), (3, 7, 1, A, 0, 0, 1), (None, 9, 2, R, 1, 1, 0)], key=str)
    counts = {r["query_id"]: r for r in co.grade_counts(hits).collect()}
    assert all(r[4:] == tuple(counts[r[0]][g] for g in ("relevant", "irrelevant", "ambiguous")) for r in got)


def test_merge_keeps_first_pass_and_counts_twice(spark, rows):
    first = graded(spark, {1: [(1, R), (2, I), (3, A)], 2: [(5, I)], 3: [(9, I)]})
    second = graded(spark, {1: [(3, R), (2, R), (4, I)]})
    rewrites = spark.createDataFrame([(1, "better"), (2, "unused"), (3, "empty")], "query_id long, rewritten_query string")
    kept, summary = co.corrective_merge(first, second, rewrites)
    assert rows(kept, "query_id", "item_id", "pass", "grade") == [(1, 1, 1, R), (1, 2, 2, R), (1, 3, 1, A)]
    got = {r["query_id"]: r for r in summary.collect()}
    assert (got[1]["total"], got[1]["relevant"], got[1]["irrelevant"], got[1]["ambiguous"]) == (6, 3, 2, 1)
    assert (got[1]["distinct_kept"], got[1]["query_rewritten"], got[1]["rewritten_query"]) == (3, True, "better")
    assert (got[2]["distinct_kept"], got[2]["query_rewritten"], got[2]["rewritten_query"]) == (0, False, None)


def test_truth_and_class_scores(spark):
    kinds = spark.createDataFrame([("rag",), ("sql",), ("hybrid",), ("negative",), ("x",), (None,)], "k string")
    got = [r[0] for r in kinds.select(bh.truth_from_type(F.col("k"))).collect()]
    assert got == ["unstructured", "structured", "hybrid", "unstructured", "unstructured", "unstructured"]
    matrix = spark.createDataFrame(
        [("structured", "structured", 3), ("structured", "hybrid", 1), ("unstructured", "structured", 2), ("other", "structured", 50)],
        "truth string, predicted string, n long",
    )
    scores = {r["class"]: r for r in bh.class_scores(matrix).collect()}
    assert (scores["structured"]["precision"], scores["structured"]["recall"]) == (0.6, 0.75)
    assert (scores["hybrid"]["f1"], scores["hybrid"]["support"]) == (0.0, 0)
    assert set(scores) == {"hybrid", "structured", "unstructured"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", True),
        (None, True),
        ("No cuento con SUFICIENTE información para ello", True),
        ("INFORMACIÓN NO ENCONTRADA en el contexto", True),
        ("no dispongo de esa información", True),
        ("no dispongo de\nesa información", False),
        ("está fuera del alcance", True),
        ("La asignatura tiene 6 créditos", False),
    ],
)
def test_abstentions(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(bh.is_abstention(F.col("t")).alias("x")).first()["x"] is expected


def test_abstention_metrics(spark):
    data = [(1, "adversarial", True, True), (2, "adversarial", True, False), (3, "well_formed", True, True), (4, "well_formed", False, True), (5, "well_formed", False, False)]
    df = spark.createDataFrame(data, "query_id long, partition string, expected boolean, actual boolean")
    m = bh.abstention_metrics(df).first()
    assert (m["accuracy"], m["false_rate"], m["adversarial_accuracy"]) == (0.6667, 0.5, 0.5)
    kinds = {r["query_id"]: r["kind"] for r in bh.abstention_failures(df).collect()}
    assert kinds == {2: "missed_abstention", 4: "false_abstention"}
    none = bh.abstention_metrics(df.filter("query_id > 9")).first()
    assert none["accuracy"] == 0.0


def test_accuracy_sums_and_confidence(spark):
    data = [("a", "structured", "structured", 0.9), ("a", "structured", "hybrid", 0.4), ("b", "hybrid", "hybrid", 0.7)]
    df = spark.createDataFrame(data, "partition string, truth string, predicted string, confidence double")
    got = {r["partition"]: r for r in bh.accuracy(df).collect()}
    assert got["overall"]["n_queries"] == 3 and got["a"]["accuracy"] == 0.5
    assert bh.confusion(df).agg(F.sum("n")).first()[0] == 3
    stats = {r["group"]: r for r in bh.confidence_stats(df).collect()}
    assert stats["correct"]["n"] == 2 and stats["incorrect"]["max"] == 0.4 and stats["overall"]["min"] == 0.4
