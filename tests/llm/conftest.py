import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, "
    "_key string, _class string, _language string, matches string, spans string, n_tokens string, "
    "shard string, kept string, size string, _own string"
)


def words(n, seed=0):
    """Invented words, another sequence for each seed."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(n))


ODD = [
    (1, words(40, 1), "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, " \n\t ", "en", "a"),
    (5, words(40, 1), "de", "b"),  # equal to 1
    (6, words(20_000, 2), "en", "a"),
    (7, "x" * 300_000, None, None),  # one word without end
    (8, "🙂 日本語 ß ÉÀ     á", "de", "b"),
    (None, words(40, 3), "en", "a"),
    (None, None, None, None),
    (9, words(40, 1).upper(), "en", "a"),  # equal but for case
    (10, "one two", "en", "a"),
    (10, "one two", "en", "a"),  # a repeated row
    (10, words(30, 4), "en", "a"),  # the same id with another text
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, huge and repeated texts, and columns named like those inside."""
    rows = [(*r, 0, *["clash"] * 12) for r in ODD]
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
