"""Language identification with a string kernel.

Two texts are as alike as the n-grams (1 to 4 characters: a blended spectrum) that both hold, each
counted once (presence), divided by the geometric mean of how many each holds. The kernel is
approximated from a few landmark texts (Nystroem), and kernel ridge regression is solved for each
language against the rest. A text's n-grams are hashed into ``N_GRAM_BITS`` bits, so a text of any
length is a bit row of fixed size; a batch of rows meets the landmarks in one matrix product and
the regression in a second.

Whether a text is in a language at all is another question than which one is nearest: it is asked of
the share of a text's n-grams that the learned texts of that language hold. What share is enough is
set by those texts themselves, each against the others, and doesn't depend on how many languages
there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import lean, whole_text

UNDETERMINED = "und"
N_GRAM_BITS = 1 << 15
ORDERS = 4
SAMPLE_ROWS = 2_048  # labelled rows that the classifier is fitted on, dealt evenly to the languages
LANDMARKS = 160
RIDGE = 1e-3
BATCH = 64  # rows of a matrix product
PIECE = 1 << 20  # characters of a text that are hashed at once
LOWEST_PART = 0.01  # the share of known n-grams that all but this part of the learned texts reach ...
SLACK = 0.85  # ... times this is asked of a text

_NOT_LETTERS = re.compile(r"[\W\d_]+")
# Odd multipliers of the rolling n-gram hash.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def mark_ngrams(text: str, row: np.ndarray) -> None:
    """Set the bits of all n-grams of a text: letters in lower case, anything else as one space."""
    letters = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    for at in range(0, len(letters), PIECE):
        piece = letters[at : at + PIECE + ORDERS - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), dtype=np.uint32)
        grams = codes * _MIX[0]
        for n in range(ORDERS):
            if n:
                if len(codes) <= n:
                    break
                grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * _MIX[n] + codes[n:] * _MIX[0]
            row[(grams ^ (grams >> np.uint32(16))) % np.uint32(N_GRAM_BITS)] = 1


@dataclass
class Model:
    """Landmarks (a bit row each), weights landmark x language, and the n-grams of each language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    held: np.ndarray  # a bit row for each language
    least: float  # share of known n-grams that a text of one of the languages has

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return kernel(rows, self.landmarks) @ self.weights

    def known(self, rows: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """Share of each row's n-grams that its language holds; few n-grams count with their uncertainty."""
        return _known(rows, (rows @ self.held.T)[np.arange(len(rows)), languages])


def _known(rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
    n = np.maximum(rows.sum(1), 1)
    return np.minimum(1.0, shared / n + 1 / np.sqrt(n))


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Presence kernel of bit rows: shared n-grams over the geometric mean of both counts."""
    shared = rows @ landmarks.T
    norms = np.sqrt(np.maximum(rows.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))
    return np.hstack([shared / norms, np.ones((len(rows), 1), rows.dtype)])


def _unpacked(packed: np.ndarray) -> Iterator[np.ndarray]:
    """The bit rows, ``BATCH`` at once: as numbers, a row has 32 times as many bytes."""
    for at in range(0, len(packed), BATCH):
        yield np.unpackbits(packed[at : at + BATCH], axis=1).astype(np.float32)


def fit(packed: np.ndarray, labels: list[str]) -> Model:
    """Kernel ridge regression, one language against the rest, in the span of the landmarks.

    ``packed`` holds a packed bit row for each label; all products are counts of bits, which come out the
    same in whatever blocks they are made.
    """
    languages = sorted(set(labels))
    by_language = [[i for i, x in enumerate(labels) if x == name] for name in languages]
    each = -(-LANDMARKS // max(1, len(languages)))
    chosen = sorted(i for own in by_language for i in own[:each])[: max(LANDMARKS, len(languages))]
    landmarks = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
    against = np.concatenate([kernel(rows, landmarks) for rows in _unpacked(packed)]).astype(np.float64)
    among = np.zeros((len(chosen) + 1,) * 2)
    among[:-1, :-1] = kernel(landmarks, landmarks)[:, :-1]
    among += 1e-9 * np.eye(len(among))
    targets = np.array([[1.0 if x == name else -1.0 for name in languages] for x in labels])
    # every language weighs the same, however many samples it has
    share = np.array([1 / len(by_language[languages.index(x)]) for x in labels])
    share *= len(labels) / share.sum()
    gram = against.T @ (against * share[:, None]) + RIDGE * len(labels) * among
    weights = np.linalg.solve(gram, against.T @ (targets * share[:, None]))
    # texts that hold each n-gram, by language; a text's own n-grams need another text to be known
    own = np.array([languages.index(x) for x in labels])
    texts = np.zeros((len(languages), packed.shape[1] * 8), dtype=np.float32)
    for at, rows in zip(range(0, len(own), BATCH), _unpacked(packed)):
        texts += np.eye(len(languages), dtype=np.float32)[own[at : at + BATCH]].T @ rows
    others, known = (texts > 1).T.astype(np.float32), []
    for at, rows in zip(range(0, len(own), BATCH), _unpacked(packed)):
        shared = (rows @ others)[np.arange(len(rows)), own[at : at + BATCH]]
        known.append(_known(rows, shared))
    least = SLACK * float(np.quantile(np.concatenate(known), LOWEST_PART))
    held = (texts > 0).astype(np.float32)
    return Model(languages, landmarks, weights.astype(np.float32), held, least)


def _bits(df: DataFrame) -> DataFrame:
    """``<_lang, _rank, _row>``: the packed n-gram bits of ``_text``, a fixed number of bytes a row."""

    @lean
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["_text"]:
                row = np.zeros(N_GRAM_BITS, dtype=np.uint8)
                mark_ngrams(t, row)
                out.append(np.packbits(row).tobytes())
            yield pd.DataFrame({"_lang": batch["_lang"], "_rank": batch["_rank"], "_row": out})

    return df.mapInPandas(pack, "_lang string, _rank long, _row binary")


def train(
    df: DataFrame, learn: Column, lang: str = "lang", text: str = "text", id: str = "doc_id"
) -> Model | None:
    """Fit on rows where ``learn`` holds and the label isn't null; None if there are none.

    Of each language the rows with the smallest hashes are taken, in turns, until ``SAMPLE_ROWS``
    are reached. Only their n-gram bits (4 KB each) go to the driver.
    """
    rows = df.where(learn & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("_lang"),
        F.xxhash64(F.col(id)).alias("_hash"),
        whole_text(text).alias("_text"),
    )
    rows = rows.where(F.col("_text").rlike(r"\p{L}"))
    # rows that can be among the first of their language: cheap to tell from the counts of hashes
    counts = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.orderBy(F.desc("_n"), "_lang").limit(SAMPLE_ROWS)
    bound = (F.lit(4.0 * SAMPLE_ROWS) / F.col("_n")).alias("_share")
    near = rows.join(F.broadcast(largest.select("_lang", bound)), "_lang").where(
        F.pmod("_hash", F.lit(1_000_003)) / 1_000_003 <= F.col("_share")
    )
    order = Window.partitionBy("_lang").orderBy("_hash", "_text")
    ranked = near.withColumn("_rank", F.row_number().over(order).cast("long"))
    sample = (
        ranked.where(F.col("_rank") <= SAMPLE_ROWS)
        .orderBy("_rank", "_lang")
        .limit(SAMPLE_ROWS)
        .select("_lang", "_rank", "_text")
    )
    found = sorted(_bits(sample).collect(), key=lambda r: (r["_rank"], r["_lang"]))
    if not found:
        return None
    bits = np.frombuffer(b"".join(r["_row"] for r in found), dtype=np.uint8).reshape(len(found), -1)
    return fit(bits, [r["_lang"] for r in found])


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows and columns, and ``_language: struct<lang, score, known>``, from the text alone.

    The score is the winning margin brought to 0 to 1, ``known`` the share of the text's n-grams that
    the language holds (below ``model.least``, the text is in none of the languages). A text that is null or has no letter, or
    any text when nothing could be learned, is ``und`` with score and share 0. Ties go to the first language
    by name.
    """
    packed = None
    if model is not None:
        bits = np.packbits(model.landmarks.astype(np.uint8), axis=1)
        held = np.packbits(model.held.astype(np.uint8), axis=1)
        # landmarks, weights and languages have a fixed size: a bit row and a weight row each
        packed = df.sparkSession.sparkContext.broadcast((model.languages, bits, model.weights, held, model.least))

    @F.pandas_udf("lang string, score double, known double")
    @lean
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if packed is not None:
            languages, bits, weights, held, least = packed.value
            landmarks, held = (np.unpackbits(b, axis=1).astype(np.float32) for b in (bits, held))
            fitted = Model(languages, landmarks, weights, held, least)
        for texts in batches:
            names = [UNDETERMINED] * len(texts)
            scores, shares = np.zeros(len(texts)), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if t is not None and _has_letter(t)]
            for at in range(0, len(lettered) if packed is not None else 0, BATCH):
                block = lettered[at : at + BATCH]
                rows = np.zeros((len(block), N_GRAM_BITS), dtype=np.float32)
                for k, i in enumerate(block):
                    mark_ngrams(texts.iloc[i], rows[k])
                margins = fitted.margins(rows)
                shares[block] = fitted.known(rows, margins.argmax(1))
                for i, m in zip(block, margins):
                    names[i] = languages[int(m.argmax())]
                    scores[i] = min(1.0, max(0.0, (float(m.max()) + 1) / 2))
            yield pd.DataFrame({"lang": names, "score": scores, "known": shares})

    return df.withColumn("_language", identify(F.col(text).cast("string")))


_LETTER = re.compile(r"[^\W\d_]")


def _has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def held_out(id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 modulo 4; null ids don't."""
    crc = F.crc32(F.col(id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def identify_languages(
    df: DataFrame, id: str = "doc_id", lang: str = "lang", text: str = "text"
) -> DataFrame:
    """``<id, held_out, lang_pred, score>`` of every row, learned from the rows not held out.

    Rows with a null id are neither held out nor learned from. Repeated rows stay. Other columns
    are not read, whatever their names.
    """
    rows = df.select(F.col(id).alias("_id"), F.col(lang).alias("_label"), F.col(text).alias("_text"))
    model = train(rows, ~held_out("_id") & F.col("_id").isNotNull(), "_label", "_text", "_id")
    return predict(rows.select("_id", "_text"), model, "_text").select(
        F.col("_id").alias(id),
        held_out("_id").alias("held_out"),
        F.col("_language.lang").alias("lang_pred"),
        F.col("_language.score").alias("score"),
    )
