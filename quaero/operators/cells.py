"""Approximate dense search over stored cells with residual codes.

Vectors are dealt to cells by their nearest centre and stored cell by cell, each with a short code: what
is left of it after its centre, part by part as the number of the nearest entry of a codebook. A
question reads the codes of its nearest cells only. Its inner product with any code is a sum of table
entries; the best of these sums name a short list, whose exact vectors are read and scored. Centres
and codebooks are fitted on ``SAMPLE_ROWS`` vectors at most; every vector is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.operators.blocks import apply_blocks
from quaero.operators.dense import SCORE_DIGITS, cosine
from quaero.operators.sizing import fits, items_of_hits, lookup_join, materialise, top_per_key

SAMPLE_ROWS = 65_536  # vectors that centres and codebooks are fitted on
CODES = 256  # entries of a codebook: a part's number is one byte
STEPS = 12
SPREAD = 8  # tasks that write one cell, so that a full cell is no single task
SHORTLIST = 10  # codes that are looked at exactly, for each hit that is asked for


def _nearest(rows: np.ndarray, centres: np.ndarray, block: int = 8_192) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    parts = [np.argmax(rows[a : a + block] @ centres.T - half, axis=1) for a in range(0, len(rows), block)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _centres(rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Lloyd's means; a centre that no row is nearest to stays where it is."""
    random = np.random.default_rng(seed)
    centres = rows[random.permutation(len(rows))[:count]].copy()
    for _ in range(STEPS):
        own = _nearest(rows, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Quantizer:
    """Centres of cells, and a codebook for each part of what is left after a centre."""

    centres: np.ndarray
    books: list[np.ndarray]

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rows, len(self.books), axis=1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of every row."""
        cells = _nearest(rows, self.centres)
        parts = self.split(rows - self.centres[cells])
        return cells, np.stack([_nearest(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def tables(self, questions: np.ndarray) -> np.ndarray:
        """Inner products question x part x entry."""
        out = np.zeros((len(questions), len(self.books), CODES))
        for m, (q, book) in enumerate(zip(self.split(questions), self.books)):
            out[:, m, : len(book)] = q @ book.T
        return out

    def probed(self, questions: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each question."""
        half = (self.centres * self.centres).sum(1) / 2
        return np.argsort(half - questions @ self.centres.T, axis=1, kind="stable")[:, :probes]


def train(corpus: DataFrame, cells: int = 64, parts: int = 16, seed: int = 42) -> Quantizer:
    """Fit on the ``SAMPLE_ROWS`` rows of ``corpus<item_id, vector>`` whose ids have the smallest hashes."""
    rows = corpus.select("vector", F.xxhash64("item_id").alias("_h")).dropna(subset=["vector"])
    found = rows.orderBy("_h").limit(SAMPLE_ROWS).toPandas()
    if found.empty:
        raise ValueError("nothing to learn cells from")
    x = np.stack(found["vector"].to_numpy()).astype(np.float64)
    centres = _centres(x, min(cells, len(x)), seed)
    left = x - centres[_nearest(x, centres)]
    books = [_centres(p, min(CODES, len(x)), seed + 1) for p in np.array_split(left, parts, axis=1)]
    return Quantizer(centres, books)


def write_cells(corpus: DataFrame, path: str, quantizer: Quantizer) -> None:
    """Store ``<item_id, code, vector>`` by cell. Null vectors are not stored."""
    rows = corpus.select(F.col("item_id").cast("long"), "vector").dropna(subset=["vector"])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cells, codes = quantizer.encode(np.stack(frame["vector"].to_numpy()))
                yield frame.assign(cell=cells.astype(np.int32), code=[c.tobytes() for c in codes])

    coded = rows.mapInPandas(encode, "item_id long, vector array<double>, cell int, code binary")
    spread = F.pmod(F.xxhash64("item_id"), F.lit(SPREAD))
    coded.repartition(F.col("cell"), spread).write.mode("overwrite").partitionBy("cell").parquet(path)


@dataclass(frozen=True)
class CellIndex:
    spark: SparkSession
    path: str
    quantizer: Quantizer

    def cells(self, wanted: list[int]) -> DataFrame:
        """The rows of some cells; the folders of the others are not read."""
        return self.spark.read.parquet(self.path).where(F.col("cell").isin(wanted))


def _kernel(quantizer: Quantizer, probes: int, keep: int):
    """The best ``keep`` codes of each question among its cells, over a stream of code rows."""

    def run(frames: Iterator[pd.DataFrame], questions: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if questions.empty:
            return
        q = np.stack(questions["vector"].to_numpy())
        tables, probed = quantizer.tables(q), quantizer.probed(q, probes)
        asks = np.zeros((len(q), len(quantizer.centres)), dtype=bool)
        np.put_along_axis(asks, probed, True, axis=1)
        base = q @ quantizer.centres.T
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0),) * 3] * len(q)
        for frame in frames:
            codes = np.frombuffer(b"".join(frame["code"]), dtype=np.uint8).reshape(len(frame), -1)
            cells, ids = frame["cell"].to_numpy(), frame["item_id"].to_numpy()
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                for i in np.flatnonzero(asks[:, cell]):
                    scores = base[i, cell] + tables[i][np.arange(codes.shape[1]), codes[at]].sum(1)
                    old = best[i]
                    scores = np.concatenate([old[0], scores])
                    which = np.concatenate([old[1], ids[at]])
                    where = np.concatenate([old[2], np.full(len(at), cell)])
                    if len(scores) > keep:
                        some = np.argpartition(-scores, keep - 1)[:keep]
                        scores, which, where = scores[some], which[some], where[some]
                    best[i] = (scores, which, where)
        sizes = [len(b[0]) for b in best]
        yield pd.DataFrame(
            {
                "query_id": np.repeat(questions["query_id"].to_numpy(), sizes),
                "item_id": np.concatenate([b[1] for b in best]).astype(np.int64),
                "cell": np.concatenate([b[2] for b in best]).astype(np.int32),
                "about": np.concatenate([b[0] for b in best]),
            }
        )

    return run


def search(index: CellIndex, questions: DataFrame, k: int = 10, probes: int = 8, shortlist: int = SHORTLIST) -> DataFrame:
    """``<query_id, item_id, score, rank>``: about the best ``k`` items of each question, with exact scores.

    Each question meets the codes of its ``probes`` nearest cells; ``shortlist * k`` of them are scored
    by their vectors. Questions without a vector have no hits.
    """
    quantizer = index.quantizer
    asked = questions.select("query_id", "vector").dropna(subset=["vector"])

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"cell": np.unique(quantizer.probed(np.stack(frame["vector"].to_numpy()), probes))})

    # as many numbers as there are cells, at most
    wanted = sorted(r["cell"] for r in asked.mapInPandas(nearest, "cell int").distinct().collect())
    rows = index.cells(wanted)
    keep = shortlist * k
    coded = apply_blocks(
        rows.select("item_id", "cell", "code"),
        asked,
        _kernel(quantizer, probes, keep),
        "query_id long, item_id long, cell int, about double",
    )
    listed = top_per_key(coded, ["query_id"], [F.col("about").desc(), F.col("item_id")], keep)
    listed = materialise(listed.select("query_id", "item_id", "cell"))
    few = fits(listed)
    found = items_of_hits(rows.select("item_id", "cell", "vector"), listed, ["item_id", "cell"], few)
    both = lookup_join(found, asked.withColumnRenamed("vector", "_q"), ["query_id"], small_fits=few)
    score = F.round(cosine(F.col("_q"), F.col("vector")), SCORE_DIGITS)
    scored = both.select("query_id", "item_id", score.alias("score"))
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)
