"""Token counts by a two-tier lookup of pre-token lengths, without moving a pre-token.

A text is cut into pre-tokens by the tokenizer's own pattern. A pre-token's number of tokens does
not depend on its neighbours, so it is looked up: first in a compact table of frequent pre-tokens
(broadcast: at most ``TABLE_SIZE`` entries), then in the worker's own cache, and only a pre-token
met for the first time is encoded. The table is a cache: it decides how fast, never what is counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import whole_text

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SAMPLE_ROWS = 4_096  # rows that the table of frequent pre-tokens is gathered from
SAMPLE_CHARS = 16_000_000  # ... and characters, so that one task gathers it in bounded memory
TABLE_SIZE = 65_536  # entries of the broadcast table
CACHE_SIZE = 400_000  # entries of a worker's own cache; when full it starts anew
LONGEST = 64  # longer pre-tokens are encoded each time and not kept


class Lengths(dict):
    """Tokens by pre-token; what is missing is encoded, and kept while there is room."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.room = len(frequent) + CACHE_SIZE
        self.frequent = frequent
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, pretoken: str) -> int:
        n = len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
        if len(pretoken) <= LONGEST:
            if len(self) >= self.room:
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n


class Counts:
    """Counts the tokens of texts as the library does, special strings included."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        import regex

        self.lengths = Lengths(path, frequent)
        self.pretokens = regex.compile(PATTERN).finditer
        added = self.lengths.tokenizer.get_added_tokens_decoder().values()
        strings = sorted((a.content for a in added), key=len, reverse=True)
        # the library takes special strings out of a text before it cuts pre-tokens
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None

    def plain(self, text: str) -> int:
        length = self.lengths.__getitem__
        return sum(length(m.group()) for m in self.pretokens(text))

    def __call__(self, text: str) -> int:
        pieces = self.special.split(text) if self.special else [text]
        return sum(map(self.plain, pieces)) + len(pieces) - 1


def frequent_pretokens(df: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample of rows (a cache, no statistic).

    One task reads at most ``SAMPLE_ROWS`` texts and ``SAMPLE_CHARS`` characters, in bounded memory.
    """
    rows = df.count()
    every = max(1, rows // SAMPLE_ROWS)
    sample = (
        df.select(whole_text(text).alias("_text"))
        .where(F.pmod(F.xxhash64("_text"), F.lit(every)) == 0)
        .limit(SAMPLE_ROWS)
    )

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        cut, seen, left = regex.compile(PATTERN), Counter(), SAMPLE_CHARS
        for batch in batches:
            for t in batch["_text"]:
                if left > 0:
                    piece = t[:left]
                    left -= len(piece)
                    seen.update(m.group() for m in cut.finditer(piece))
                if len(seen) > 8 * TABLE_SIZE:
                    seen = Counter(dict(seen.most_common(4 * TABLE_SIZE)))
        top = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if len(p) <= LONGEST]
        count = Lengths(path, {})
        top = top[:TABLE_SIZE]
        yield pd.DataFrame({"p": pd.Series(top, dtype=object), "n": [count[p] for p in top]})

    return {r.p: r.n for r in sample.mapInPandas(gather, "p string, n int").collect()}


def token_counts(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<id, n_bytes, n_tokens>`` of every row, counted over the whole text.

    A null text is empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept as they are, one
    row out for each row in; other columns of ``df`` are not read, whatever their names. An
    empty table gives no rows.
    """
    rows = df.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    frequent = df.sparkSession.sparkContext.broadcast(frequent_pretokens(df, path, text))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = Counts(path, frequent.value)
        for texts in batches:
            yield pd.Series([counts(t) for t in texts], dtype="int64")

    return rows.select(
        F.col("_id").alias(id),
        F.octet_length("_text").cast("long").alias("n_bytes"),
        count("_text").alias("n_tokens"),
    )
