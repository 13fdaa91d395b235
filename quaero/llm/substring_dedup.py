"""Repeated passages, found as runs of consecutive sentences that occur anywhere before.

Every run of ``RUN`` consecutive sentences is hashed and met with all others of the corpus; the
first one (by document, then by place) stays, and the sentences under any later one go. Sentences
here end at clause marks too, so that a passage set into the middle of other text still
holds whole runs. Runs of very few words are no passage and are not compared.

Passages without such marks are found by their words: of any ``AMONG`` windows of ``WINDOW`` words in
a row the one with the least hash is compared too (winnowing). Whatever two texts share of
``WINDOW + AMONG - 1`` words or more holds such a window, wherever sentences end, and windows of a
longer passage touch each other: only fewer than ``AMONG`` words at either end of it can stay. A
character of a script without spaces is a word here.

Runs are counted with map-side sums. A run that many documents share (more than one in
``HOT_SHARE`` of all runs; there can be no more such runs than that) is split over ``SALTS`` tasks
when it is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import cut_lineage, whole_text
from quaero.llm.words import sentences, tokens, winnowed

RUN = 3  # sentences of a run
RUN_WORDS = 12  # ... and words it has at least
MARKS = b".!?;:,"
WINDOW = 39  # words of a window; with AMONG, every passage of over 50 words holds one
AMONG = 13
WORDS_AT = 1 << 30  # places from here on are words (windows), those before are sentences (runs)
HOT_SHARE = 10_000
SALTS = 64


def _runs(df: DataFrame, windows: bool) -> DataFrame:
    """``<_id, _key, _at, _hash>``: each run of sentences of each text, and its chosen windows if asked for."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, ats, hashes = [], [], []
            for k, (text, (h, n, _)) in enumerate(zip(batch["_text"], sentences(batch["_text"], MARKS))):
                if windows:
                    every, _, lines = tokens(text)
                    at, window = winnowed(every, lines, WINDOW, AMONG)
                    rows.append(np.full(len(at), k))
                    ats.append(at + WORDS_AT)
                    hashes.append(window)
                if len(h) < RUN:
                    continue
                run, words = h[: len(h) - RUN + 1].copy(), n[: len(n) - RUN + 1].copy()
                for j in range(1, RUN):
                    run = (run ^ (run >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(run) + j]
                    words += n[j : len(words) + j]
                at = np.flatnonzero(words >= RUN_WORDS)
                rows.append(np.full(len(at), k))
                ats.append(at)
                hashes.append(run[at])
            if rows:
                row = np.concatenate(rows)
                yield pd.DataFrame(
                    {
                        "_id": batch["_id"].to_numpy()[row],
                        "_key": batch["_key"].to_numpy()[row],
                        "_at": np.concatenate(ats).astype(np.int32),
                        "_hash": np.concatenate(hashes).view(np.int64),
                    }
                )

    return df.select("_id", "_key", "_text").mapInPandas(hashed, "_id long, _key int, _at int, _hash long")


def repeated_runs(rows: DataFrame, windows: bool = False) -> DataFrame:
    """``<_id, _key, _at>``: runs of ``<_id, _key, _text>`` that stood before, in all of the corpus.

    A window has in the upper half of ``_at`` how many of its words are those of its first place.
    """
    runs = _runs(rows, windows)
    place = F.struct("_id", "_key", "_at")
    groups = runs.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    repeated = cut_lineage(groups.where(F.col("_n") > 1))
    total = repeated.agg(F.sum("_n").alias("n")).first()["n"] or 0
    # fewer than HOT_SHARE hashes can hold more than one in HOT_SHARE of the runs
    hot = repeated.where(F.col("_n") > max(10_000, total // HOT_SHARE)).select("_hash").withColumn("_hot", F.lit(True))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = repeated.join(F.broadcast(hot), "_hash", "left").select(
        "_hash", "_first", F.explode(salts).alias("_salt")
    )
    salted = runs.join(F.broadcast(hot), "_hash", "left").select(
        "_id", "_key", "_at", "_hash",
        F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt"),
    )
    same = F.struct("_id", "_key").eqNullSafe(F.struct("_first._id", "_first._key"))
    overlap = F.when(
        same & (F.col("_at") >= WORDS_AT), F.greatest(F.col("_first._at") + WINDOW - F.col("_at"), F.lit(0))
    ).otherwise(0)
    return (
        salted.join(firsts, ["_hash", "_salt"])
        .where(~F.struct("_id", "_key", "_at").eqNullSafe(F.col("_first")))
        .select("_id", "_key", (F.shiftleft(overlap.cast("long"), 32) + F.col("_at")).alias("_at"))
    )


def without_repeats(text: str, n: np.ndarray, starts: np.ndarray, runs: np.ndarray) -> tuple[str, int, int]:
    """The text without the runs and windows, how many sentences it had, and how many lost words."""
    if not len(runs):
        return text, len(n), 0
    bounds = np.r_[0, starts[1:], len(text)]
    at, skip = runs & 0xFFFFFFFF, runs >> 32
    windows = at >= WORDS_AT
    first, last = bounds[at[~windows]], bounds[at[~windows] + RUN]
    if windows.any():
        places = np.r_[0, tokens(text)[1][1:], len(text)]
        begin = at[windows] - WORDS_AT
        first, last = np.r_[first, places[begin + skip[windows]]], np.r_[last, places[begin + WINDOW]]
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > last[:-1]]
    first, last = first[new], last[np.r_[new[1:], True]]
    kept = [text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)])]
    met = np.searchsorted(last, starts, side="right")
    lost = np.r_[first, len(text)][met] < bounds[1:]
    return "".join(kept), len(n), int(lost.sum())


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", windows: bool = False) -> DataFrame:
    """``<id, n_sentences, n_removed, text>`` of every row: the text without repeated passages.

    Runs of sentences are always compared, windows of words (any passage of over 50 words) with ``windows``.
    ``id`` is an integer; null ids come first. Rows that are equal in id and text count as one row
    (all keep or lose the same sentences). A null text stays null, with no sentences; a text of
    fewer than ``RUN`` sentences is shortened by windows only. ``n_removed`` counts
    sentences that went or lost words. Other columns are not read. A document whose sentences are
    all repeats keeps its row, with an empty text.
    """
    rows = df.select(
        F.col(id).cast("long").alias("_id"),
        F.hash(whole_text(text)).alias("_key"),
        F.col(text).cast("string").alias("_text"),
    )
    found = repeated_runs(rows.where(F.col("_text").isNotNull()), windows)
    per_row = found.groupBy("_id", "_key").agg(F.collect_set("_at").alias("_runs"))

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def shorten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, runs in batches:
            found = sentences((t or "" for t in texts), MARKS)
            out = [
                (None, 0, 0) if t is None else without_repeats(t, n, starts, np.array([] if r is None else r, dtype=np.int64))
                for t, r, (_, n, starts) in zip(texts, runs, found)
            ]
            yield pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    per_row = per_row.withColumnsRenamed({"_id": "_id2", "_key": "_key2"})
    joined = rows.join(
        per_row, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left"
    )
    return joined.select(F.col("_id").alias(id), shorten("_text", "_runs").alias("_s")).select(
        id, F.col("_s.n_sentences"), F.col("_s.n_removed"), F.col("_s.text").alias("text")
    )
