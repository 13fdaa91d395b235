import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quaero.fixed_values import STOPWORDS
from quaero.functions.text import normalise_literal
from quaero.operators import prefilter as pf
from quaero.operators import routing as rt
from quaero.options import PrefilterOptions, RouterOptions

VALUES = ["Software I", "Software II", "Diseño de Bases", "Redes", "c++", "Álgebra lineal", "!!"]
QUESTIONS = {
    1: "¿Qué temas tiene Software II?",
    2: "evaluación de diseño de bases de datos",
    3: "bases y diseño",
    4: "hablame de Redess por favor",
    5: "superredes hoy",
    6: "curso de C++",
    7: "algebra lineale",
    8: "nada que ver",
    9: "software 2",
    10: "¡¡ atención!!",
}


@pytest.fixture(scope="module")
def data(spark):
    questions = spark.createDataFrame(list(QUESTIONS.items()), "query_id long, text string")
    return questions, spark.createDataFrame([(v,) for v in VALUES], "value string")


def test_substring_tier_against_direct_search(data, rows):
    questions, values = data
    want = []
    for q, text in QUESTIONS.items():
        norm = normalise_literal(text)
        for value in VALUES:
            needle = normalise_literal(value)
            at = norm.find(needle)
            end = at + len(needle)
            if at >= 0 and not norm[end : end + 1].isalnum():
                want.append((q, value, 1.5 + len(needle)))
    assert rows(pf.match_substring(questions, values), "query_id", "value", "score") == sorted(want)
    assert (5, "Redes", 6.5) in want and (10, "!!", 3.5) in want


def test_only_first_occurrence_counts(spark):
    questions = spark.createDataFrame([(1, "redess y redes")], "query_id long, text string")
    values = spark.createDataFrame([("Redes",)], "value string")
    assert pf.match_substring(questions, values).count() == 0


def test_token_tier_with_numerals(data, rows):
    questions, values = data
    got = rows(pf.match_token_overlap(questions, values), "query_id", "value", "score")
    assert (3, "Diseño de Bases", 1.0) in got
    assert (9, "Software II", 1.0) in got  # the twin of "2" meets the value's "ii"


def test_fuzzy_tier_against_all_pairs(spark):
    random.seed(5)
    letters = "abcdei "
    values = sorted({"".join(random.choice(letters) for _ in range(random.randint(4, 9))).strip() or "abcd" for _ in range(12)})
    values = [" ".join(v.split()) for v in values if len(v.split()) and len(v) >= 4]
    texts = {i: " ".join("".join(random.choice(letters) for _ in range(25)).split()) for i in range(25)}
    questions = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    frame = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r["query_id"]: (r["value"], round(r["score"], 9)) for r in pf.match_fuzzy_window(questions, frame).collect()}
    for i, text in texts.items():
        assert got.get(i) == fuzzy_brute(text, values)


def fuzzy_brute(text, values, stop=STOPWORDS, threshold=0.65):
    twins = {"i": "1", "1": "i"}
    best, found = 0.0, None
    asked = {w for w in text.split() if w not in stop}
    asked |= {twins[w] for w in asked if w in twins}
    for value in sorted(values):
        windows = [text[i : i + len(value) + 5] for i in range(max(1, len(text) - len(value) + 1))]
        score = max(SequenceMatcher(None, value, w).ratio() for w in windows)
        words = [w for w in value.split() if w not in stop]
        if len(words) >= 2 and sum(w in asked for w in words) < 2:
            score *= 0.7
        if score > best:
            best, found = score, value
    return (found, round(best, 9)) if best >= threshold else None


def test_fuzzy_blocks_give_the_same(spark, monkeypatch):
    questions = spark.createDataFrame([(i, f"precio del {w} hoy") for i, w in enumerate(["termodinamika", "electromagnetysmo", "nada"])], "query_id long, text string")
    known = [*VALUES, "Termodinámica", "Electromagnetismo", "Electrotecnia"]
    values = spark.createDataFrame([(v,) for v in known], "value string")
    whole = sorted(pf.match_fuzzy_window(questions, values).collect())
    blocks = pf.apply_blocks
    monkeypatch.setattr(pf, "apply_blocks", lambda *a: blocks(*a, batch_rows=2, big_rows=2))
    assert sorted(pf.match_fuzzy_window(questions, values).collect()) == whole and whole


def test_detection_prefers_longest_substring(data):
    questions, values = data
    got = {r["query_id"]: (r["matched_value"], r["similarity"]) for r in pf.detect_metadata_value(questions, values).collect()}
    assert got[1] == ("Software II", 1.0)
    assert got[2] == ("Diseño de Bases", 1.0)
    assert got[4][0] == "Redes" and got[4][1] < 1
    assert 8 not in got


def test_boost_order_matters(spark):
    df = spark.createDataFrame([("Metodología y temario",), ("TEMARIO",), ("otra",)], "t string")
    mapping = {"Proyecto": ["metodología"], "Programa": ["temario"]}
    got = [r[0] for r in df.select(pf.detect_boost_value(F.col("t"), mapping)).collect()]
    assert got == ["Proyecto", "Programa", None]
    assert [r[0] for r in df.select(pf.detect_boost_value(F.col("t"), {})).collect()] == [None] * 3


OPTIONS = RouterOptions(
    structured_keywords=("cuántas", "total de", "créditos", "listar", "departamento"),
    unstructured_keywords=("metodología", "evaluación"),
)


def route(spark, texts, options=OPTIONS, responses=None):
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    answers = None
    if responses is not None:
        answers = spark.createDataFrame(list(responses.items()), "query_id long, response string")
    got = rt.route_questions(questions, options, answers).collect()
    return {r["query_id"]: r for r in got}


def test_layers(spark):
    got = route(
        spark,
        [
            "Cuantas asignaturas hay",
            "explica la METODOLOGIA",
            "total de créditos y metodología",
            "hola  [Híbrido]  mundo ESTRUCTURADO",
            "no estructurado: cuántas",
            "Estructurado metodología",
            "desestructurado",
            "cuántas, total de, créditos, listar y evaluación",
        ],
        responses={2: "structured 0.9", 6: None},
    )
    assert (got[0]["source"], got[0]["method"], got[0]["confidence"]) == ("structured", "rules", 1.0)
    assert got[1]["source"] == "unstructured"
    assert (got[2]["source"], got[2]["method"]) == ("structured", "llm")
    assert (got[3]["source"], got[3]["clean_query"]) == ("hybrid", "hola [] mundo")
    assert (got[4]["source"], got[4]["clean_query"]) == ("unstructured", ": cuántas")
    assert got[5]["source"] == "structured" and got[5]["method"] == "manual_override"
    assert (got[6]["source"], got[6]["method"]) == ("unstructured", "default")
    assert got[7]["source"] == "structured" and got[7]["confidence"] == 0.8


def test_only_open_questions_go_to_the_model(spark, rows):
    texts = ["cuántas hay", "hola", "total de créditos y metodología", "híbrido: hola"]
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    assert rows(rt.undecided(questions, OPTIONS), "query_id") == [(1,), (2,)]


def test_switches(spark):
    off = route(spark, ["cuántas"], RouterOptions(enabled=False, default_source="hybrid"))
    assert (off[0]["source"], off[0]["confidence"], off[0]["reasoning"]) == ("hybrid", 1.0, "Router disabled")
    no_sql = route(spark, ["cuántas", "estructurado x"], RouterOptions(sql_enabled=False))
    assert no_sql[0]["source"] == "unstructured" and no_sql[1]["source"] == "structured"


@pytest.mark.parametrize(
    "response, source, confidence",
    [
        ("STRUCTURED 0.92", "structured", 0.92),
        ("  unstructured  ", "unstructured", 0.8),
        ("Hybrid 0.5", "hybrid", 0.5),
        ("structured 0.4", "hybrid", 0.4),
        ("STRUCTURED 1.0", "structured", 0.8),
        ("???", None, None),
        (None, None, None),
    ],
)
def test_response_parsing(spark, response, source, confidence):
    df = spark.createDataFrame([(response,)], "r string")
    got = df.select(rt.by_response(F.col("r"), OPTIONS).alias("x")).first()["x"]
    if source is None:
        assert got is None
    else:
        assert (got["source"], got["confidence"]) == (source, confidence)


def test_empty_result_fallback(spark):
    routes = spark.createDataFrame([(i, "structured") for i in range(5)] + [(9, "hybrid")], "query_id long, source string")
    tables = spark.createDataFrame([(0, True, 3), (1, True, 0), (2, False, None), (3, True, 0), (4, False, None)], "query_id long, success boolean, row_count long")
    docs = spark.createDataFrame([(0, True), (1, True), (2, True), (3, False), (4, False)], "query_id long, success boolean")
    got = {s: {r["query_id"]: (r["answer_from"], r["sources_used"]) for r in rt.empty_result_fallback(routes, tables, docs, s).collect()} for s in ("none", "try_unstructured", "try_hybrid")}
    assert got["try_unstructured"] == {
        0: ("structured", "structured"),
        1: ("unstructured", "structured,unstructured"),
        2: ("unstructured", "unstructured"),
        3: ("structured", "structured"),
        4: ("none", ""),
    }
    assert got["none"][1] == ("structured", "structured")
    assert got["try_hybrid"][1] == ("hybrid", "structured,unstructured")
    with pytest.raises(ValueError):
        rt.empty_result_fallback(routes, tables, docs, "try_sql")


def test_run_plan_loses_no_window():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(7)
    met = 0
    for _ in range(6000):
        m = rng.randrange(4, 30)
        value = "".join(rng.choice("abcde f") for _ in range(m))
        window = list(value)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(window) + 1)
            if rng.random() < 0.5 and len(window) > 2:
                del window[min(at, len(window) - 1)]
            else:
                window.insert(at, rng.choice("abcdefgh"))
        window = "".join(window)
        if not window or len(window) > m + 5:
            continue
        ratio = SequenceMatcher(None, value, window).ratio()
        for wanted in (0.5, 0.65, 0.8, 0.93):
            if ratio < wanted:
                continue
            size, needed = pf.run_plan(m, wanted, 5)
            assert size >= 1
            if size > 1:
                met += 1
                gone = sum(value[i : i + size] not in window for i in range(m - size + 1))
            else:
                gone = len(set(pf.letter_tokens(value)) - set(pf.letter_tokens(window)))
            assert gone < needed
    assert met > 500
    assert pf.run_plan(4, 1.2, 5) == (0, 0)


@pytest.mark.parametrize("options", [PrefilterOptions(), PrefilterOptions(threshold=0.8), PrefilterOptions(threshold=0.4), PrefilterOptions(threshold=0.05)])
def test_fuzzy_candidates_against_all_pairs(spark, options):
    import random

    rng = random.Random(int(options.threshold * 100))
    vocabulary = ["copper", "bolt", "nut", "steel", "washer", "zinc", "long", "short", "blue", "screw", "x9", "plate"]
    values = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4))) for _ in range(40)})
    texts = []
    for _ in range(30):
        t = list("find the " * rng.randrange(2) + rng.choice(values) + " please" * rng.randrange(2))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        texts.append("".join(t))
    texts += ["", "b", "qqqq wwww"]
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    frame = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r["query_id"]: (r["value"], round(r["score"], 9)) for r in pf.match_fuzzy_window(questions, frame, options).collect()}
    for i, text in enumerate(texts):
        assert got.get(i) == fuzzy_brute(text, [v for v in values if len(v) > 3], threshold=options.threshold), text
    asked = pf.normal_questions(questions).withColumn("words", pf.tx.expand_numerals(pf.tx.significant_tokens(F.col("norm"))))
    known = pf.known_values(frame).withColumn("words", pf.tx.significant_tokens(F.col("norm"))).filter(F.length("norm") >= 4)
    pairs, others = pf.fuzzy_candidates(asked, known, options)
    if options.threshold >= 0.65:
        assert others.count() == 0 and pairs.count() < 0.6 * len(texts) * known.count()
