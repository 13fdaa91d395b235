import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaero import options as op
from quaero.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_normalise_matches_unicode_rule(spark):
    words = ["CANCIÓN", "Straße", "İñigo çà", "áb", "Ångström", "ŁÓDŹ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["x"] for r in df.select(tx.normalise(F.col("w")).alias("x")).collect()]
    for word, norm in zip(words, got):
        decomposed = unicodedata.normalize("NFKD", word.lower())
        assert norm == "".join(c for c in decomposed if not unicodedata.combining(c))


def test_tokens_and_stopwords(spark):
    words = tx.significant_tokens(tx.normalise(F.col("t")))
    assert one(spark, F.concat_ws(" ", words), t="¿Qué es la Física II, de 2º_curso?") == "fisica ii 2o_curso"


def test_numerals_both_ways(spark):
    words = tx.expand_numerals(tx.tokens(F.col("t")))
    got = set(one(spark, F.concat_ws(" ", words), t="fisica ii 4 xi").split())
    assert got == {"fisica", "ii", "2", "4", "iv", "xi"}


def test_token_estimates(spark):
    assert one(spark, tx.estimate_tokens(F.col("t")), t="abcdefghi") == 2
    assert one(spark, tx.word_count(F.col("t")), t="   ") == 1
    assert one(spark, tx.word_count(F.col("t")), t=" a\n b\tc ") == 3


def test_count_contained(spark):
    assert one(spark, tx.count_contained(F.col("t"), ["ab", "abc", "x"]), t="zabcz") == 2
    assert one(spark, tx.count_contained(F.col("t"), []), t="zabcz") == 0


@settings(max_examples=20, deadline=None)
@given(st.floats(0, 1))
def test_fusion_options_accept_shares(alpha):
    assert op.FusionOptions(alpha=alpha).alpha == alpha


@pytest.mark.parametrize(
    "make",
    [
        lambda: op.ChunkOptions(size=0),
        lambda: op.ChunkOptions(size=10, overlap=10),
        lambda: op.FusionOptions(alpha=1.5),
        lambda: op.CorrectiveOptions(relevance_threshold=-0.1),
        lambda: op.RouterOptions(default_source="elsewhere"),
        lambda: op.PrefilterOptions(threshold=2),
        lambda: op.ContextOptions(max_chars=0),
    ],
)
def test_bad_options_raise(make):
    with pytest.raises(ValueError):
        make()
