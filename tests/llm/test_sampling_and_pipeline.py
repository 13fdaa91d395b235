"""Sampled segmentations, and the pipeline stage by stage."""

import math
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quaero.llm import queries, secret_scans, sentencepiece_sampling
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece_sampling.Model(PATH)


def all_ways(model, text):
    """Every segmentation of a short text with its probability."""
    plain = [i for i in model.ids]
    weight = {model.pieces[i]: (int(i), w) for i, w in zip(plain, model.weights)}
    text = "▁" + text.replace(" ", "▁")

    def ways(at):
        if at == len(text):
            yield (), 0.0
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in weight:
                i, w = weight[text[at:end]]
                for ids, rest in ways(end):
                    yield (i, *ids), w + rest

    found = dict(ways(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {ids: math.exp(w - total) for ids, w in found.items()}


@pytest.mark.parametrize("text", ["the", "a cat", "of  it"])
def test_samples_without_replacement_follow_the_distribution(model, text):
    exact, n = all_ways(model, text), 6000
    found = sentencepiece_sampling.sample_group(model, [text] * n, np.arange(n, dtype=np.uint64), 2)
    pairs = Counter()
    for one in found:
        a, b = (tuple(s[0].tolist()) for s in one)
        assert a != b
        assert abs(math.exp(one[0][1]) - exact[a]) < 1e-3 * max(1e-3, exact[a]) + 1e-5
        assert 0 <= one[1][2] <= 1
        pairs[a, b] += 1
    chi = 0.0
    for (a, p), (b, q) in ((x, y) for x in exact.items() for y in exact.items() if x[0] != y[0]):
        want = n * p * q / (1 - p)
        if want > 20:
            assert abs(pairs[a, b] - want) < 5 * math.sqrt(want)
            chi += 1
    assert chi


def test_inclusion_scores_estimate_sums(model):
    """An indicator weighted by probability over inclusion has the probability's sum as its mean."""
    exact, n, k = all_ways(model, "the cat"), 3000, 3
    found = sentencepiece_sampling.sample_group(model, ["the cat"] * n, np.arange(n, dtype=np.uint64), k)
    got = np.mean([sum(math.exp(s[1]) / s[2] for s in one) for one in found])
    assert abs(got - sum(exact.values())) < 0.05


def test_all_ways_come_out_once_in_order_of_their_noise(model):
    exact = all_ways(model, "cat")
    found = sentencepiece_sampling.sample_group(model, ["cat"], np.array([5], dtype=np.uint64), len(exact) + 5)[0]
    ways = [tuple(s[0].tolist()) for s in found]
    assert len(set(ways)) == len(ways) and set(ways) <= set(exact)
    assert sum(exact[w] for w in ways) > 1 - 1e-4


def test_best_first_listing_is_complete(model):
    lattices = sentencepiece_sampling.Lattices(model)
    lattices.add(["▁cats"], 1)
    listed = list(lattices.ways(0))
    exact = all_ways(model, "cats")
    assert {ids for ids, _ in listed} == set(exact)
    assert all(a[1] >= b[1] - 1e-6 for a, b in pairwise(listed))


def test_segmentations_decode_to_the_text(model, documents):
    texts = [r["text"] for r in documents.limit(60).collect()]
    texts += ["", " ", "  lead", "trail  ", "tab\there", "🙂\U0010fffd", "日本語のテキスト", "a\n\n\nb", "x" * 500, "  "]
    found = sentencepiece_sampling.sample_group(model, texts, np.arange(len(texts), dtype=np.uint64), 2)
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PATH)
    for t, one in zip(texts, found):
        for ids, _, _ in one:
            assert model.decode(ids.tolist()) == t == library.decode(ids.tolist())


def test_samples_don_t_depend_on_neighbours(model, documents, monkeypatch):
    texts = [r["text"] for r in documents.limit(20).collect()]
    keys = np.arange(20, dtype=np.uint64)
    together = sentencepiece_sampling.sample_group(model, texts, keys, 2)
    monkeypatch.setattr(sentencepiece_sampling, "EDGES", 0)  # the table starts anew each time
    for k in range(20):
        alone = sentencepiece_sampling.sample_group(model, texts[k : k + 1], keys[k : k + 1], 2)[0]
        assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in together[k]]


def test_segmentation_query(spark):
    rows = queries.op6_sentencepiece_sampling(spark, SF).collect()
    assert all(r["round_trip"] for r in rows)
    assert all(r["n_segmentations"] == 2 and len(set(r["ids_hash"])) == 2 for r in rows if r["n_pieces"][0] > 5)


def test_segmentations_of_odd_rows(odd, none):
    rows = sentencepiece_sampling.sample_segmentations(odd, PATH).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: r["segmentations"] for r in rows}
    assert found[2] is None and [list(s["ids"]) for s in found[3]] == [[]]
    assert sentencepiece_sampling.sample_segmentations(none, PATH).collect() == []
    assert all(r["round_trip"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    decoded = sentencepiece_sampling.sample_segmentations(odd, PATH).select(
        "doc_id", sentencepiece_sampling.decode_ids(F.get("segmentations.ids", F.lit(0)), PATH).alias("t")
    )
    assert all(r["t"] == texts[r["doc_id"]] for r in decoded.collect() if r["doc_id"] not in (None, 10))


def test_stages(spark, documents):
    docs = documents
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = before = docs
        docs = stage(spark, docs, SF).cache()
        if name != "sentencepiece":
            assert docs.columns == documents.columns
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    copies = seen["decontamination"].select("text").distinct().count()
    assert copies == seen["decontamination"].count() < seen["ngram_jaccard"].count()
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [" ".join(r["text"].lower().split()) for r in seen["secret_scans"].collect()]
    assert not any(i in t for i in items for t in clean)
    for r in seen["sentencepiece"].collect():
        assert not secret_scans.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert docs.count() == seen["sentencepiece"].count()


def test_texts_of_no_learned_language_are_dropped(spark):
    """Gibberish and an unseen language go, with three languages or four; short clean texts stay."""
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").cache()
    gibberish = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) for n in (8, 20, 100)]
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными"]
    clean = [" ".join(r["text"].split()[:6]) for r in docs.where("n_chars > 500").orderBy("doc_id").limit(40).collect()]
    extra = spark.createDataFrame(
        [(-1 - k, t, None, "x", len(t)) for k, t in enumerate(gibberish + foreign)] + [(-100 - k, t, None, "x", len(t)) for k, t in enumerate(clean)],
        docs.schema,
    )
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.union(extra), SF).collect()}
    assert not kept & {-1 - k for k in range(5)}
    assert len(kept & {-100 - k for k in range(40)}) >= 39
    assert sum(d >= 0 for d in kept) >= 0.995 * docs.where("text rlike '[a-z]'").count()
    unseen = docs.where("lang = 'es'").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, docs.where("lang <> 'es'").union(unseen), SF)
    assert kept.where("source is not null").join(unseen, "doc_id").count() <= 0.05 * unseen.count()


def test_stages_of_odd_rows(spark, odd, none):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for df in (plain, odd, plain.limit(0)):
            out = stage(spark, df, SF)
            assert out.count() <= len(ODD), name


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "segmentations", "round_trip"] and out.where(F.size("segmentations") == 0).count() == 0


def test_every_operator_has_a_query():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert {k.split("_")[0] for k in names if k[2].isdigit()} >= {f"op{n}" for n in range(1, 11)}


@pytest.mark.parametrize("text", ["a", "b", "ab", "the", "1", "é", "a b", "🙂", "e"])
def test_short_texts_give_all_their_segmentations(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_sampling.Model(path)
    lattices = model.lattices
    own = lattices.add(iter(units := model.units(text)), len(units))
    every = {()}
    for u in own:
        every = {a + w for a in every for w, _ in lattices.ways(int(u))}
    number = int(np.prod(lattices.many[own]))
    assert number == len(every)
    some = min(number, 40)
    for key in range(12):
        found = sentencepiece_sampling.sample_group(model, [text], np.array([key], dtype=np.uint64), some + 3)[0]
        got = [tuple(s[0].tolist()) for s in found]
        want = {tuple(sentencepiece_sampling._spelled(model, np.array(w, dtype=np.int32)).tolist()) for w in every}
        assert len(set(got)) == len(got) == min(number, some + 3) and set(got) <= want


def test_a_word_without_end_is_laid_out_in_parts():
    model = sentencepiece_sampling.Model(public_tokenizers.path("piece_bpe_32k.model"))
    text = "x" * 20_000 + " " * 9_000 + "é" * 5_000
    units = model.units(text)
    assert max(map(len, units)) <= 2 * sentencepiece_sampling.LONGEST_UNIT and "".join(units)[1:].replace("▁", " ") == text
    for ids, _, _ in sentencepiece_sampling.sample_group(model, [text], np.array([5], dtype=np.uint64), 2)[0]:
        assert model.decode(ids.tolist()) == text and model.spells(ids, text.encode())


def test_rows_are_added_as_numpy_adds_the_numbers_of_a_row():
    generator = np.random.default_rng(7)
    for n in (1, 2, 7, 8, 9, 15, 16, 17, 31, 40):
        table = np.exp(generator.normal(0, 9, (300, n))).astype(np.float32)
        assert np.array_equal(sentencepiece_sampling._added(np.ascontiguousarray(table.T)), table.sum(1)), n


def test_pieces_whose_hashes_begin_alike_are_all_found(model):
    assert model.deepest > 1
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    asked = np.concatenate([model.hashes, h])
    ids, weights = model.look_up(asked)
    place = {int(x): k for k, x in enumerate(model.hashes)}
    wanted = [place.get(int(x), -1) for x in asked]
    assert [int(i) for i in ids] == [int(model.ids[k]) if k >= 0 else -1 for k in wanted]
    assert [float(w) for w in weights] == [float(model.weights[k]) if k >= 0 else -np.inf for k in wanted]


def test_distinct_units_are_those_of_each_text(model):
    texts = ["", "a  b", " ", "\n", "\n\n x\n", "tail  ", "  lead\n", "▁▁a ▁b", "été … 日本 🙂", "a b a b", "x" * 300 + " " * 70, "end\n"]
    for some in (texts, texts[::-1], [""], [], ["w" * 9_000 + " é", "a"], ["\ud800 a", "a"]):
        units, which, sizes = model.distinct_units(some)
        assert len(set(units)) == len(units) and len(sizes) == len(some)
        ends = np.cumsum([0, *sizes])
        assert [[units[i] for i in which[a:z]] for a, z in pairwise(ends)] == [model.units(t) for t in some]


def test_units_asked_for_again_stay_in_a_full_table(model):
    lattices = sentencepiece_sampling.Lattices(model, 300)
    often = ["▁the", "▁of", "▁cats"]
    for k in range(40):
        lattices.add([*often, *(f"▁rare{k}x{j}" for j in range(3))], 6)
    assert lattices.used < 600 and "▁rare0x0" not in lattices.numbers
    laid_out, lattices._lay_out = [], lambda units, lengths: laid_out.extend(units)
    kept = lattices.add(often, 3)
    assert not laid_out
    alone = sentencepiece_sampling.Lattices(model)
    for a, b in zip(kept, alone.add(often, 3)):
        assert list(lattices.ways(int(a))) == list(alone.ways(int(b))) and lattices.many[a] == alone.many[b]


def test_samples_of_a_group_are_held_against_its_texts(model):
    texts = ["a cat", "", "été 🙂", "b\n"]
    found = sentencepiece_sampling.sample_group(model, texts, np.arange(4, dtype=np.uint64), 2)
    assert model.spell(found, texts) == [True] * 4
    assert model.spell(found, ["a cat", "x", "été", "b\n"]) == [True, False, False, True]
    assert model.spell(found, ["a cab", "", "été 🙂", "b\n"]) == [False, True, True, True]
    assert model.spell([], []) == []
