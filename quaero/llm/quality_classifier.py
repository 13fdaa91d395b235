"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives every word a fixed sparse row of +1 and -1, and adds up, over the whole corpus,
the rows of the words that stand next to it: words of like company get like vectors. Words are kept
by a hash in ``BUCKETS`` rows of ``WIDTH`` numbers, so the table has one size for any corpus. A document
is the mean of its words' vectors, of their squares and of the products of neighbours (a word that
stands next to itself shows there). A network of two layers, fitted on labelled rows, scores it; one
temperature, fitted on other labelled rows, makes its scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import whole_text
from quaero.llm.words import byte_runs, mix

BUCKETS = 1 << 14  # rows of the word table
WIDTH = 64  # numbers of a word's vector
NONZERO = 4  # entries of a word's random row that aren't 0
REACH = 2  # words to either side that count as company
SAMPLE_ROWS = 8_192  # labelled rows that the network is fitted on, half of each label
HIDDEN = 24
STEPS = 400
RATE = 0.01
DECAY = 1e-4
SEED = 13
CALIBRATION = 5  # one in so many of the sampled rows sets the temperature and nothing else


def words_of(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words of several texts, and where each text's words begin (and the last one's end).

    A word is a run of letters and digits, or of other characters that are no white space.
    """
    for hashes, cuts in byte_runs(texts):
        yield (hashes % np.uint64(BUCKETS)).astype(np.int64), cuts


def random_rows() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's random row."""
    keys = np.arange(BUCKETS * NONZERO, dtype=np.uint64).reshape(BUCKETS, NONZERO)
    drawn = mix(keys * np.uint64(2) + np.uint64(1) + np.uint64(SEED) * np.uint64(1 << 32))
    return (drawn % np.uint64(WIDTH)).astype(np.int64), np.where(drawn >> np.uint64(63), 1, -1)


def add_company(table: np.ndarray, words: np.ndarray, cuts: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> None:
    """Add the random rows of each word's neighbours (in its own text) to the word's row of the table."""
    places, signs = rows
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    flat = table.reshape(-1)
    for d in range(1, REACH + 1):
        same = text[d:] == text[:-d]
        left, right = words[:-d][same], words[d:][same]
        for word, other in ((left, right), (right, left)):
            for j in range(NONZERO):
                at = word * WIDTH + places[other, j]
                flat += np.bincount(at, weights=signs[other, j], minlength=flat.size).astype(flat.dtype)


def company(df: DataFrame) -> np.ndarray:
    """The word table of ``_text`` over all rows: ``BUCKETS`` x ``WIDTH`` sums.

    Each task adds up its own table and hands on the rows that aren't 0; Spark adds the rows of all tasks,
    first in the tasks. The result has a fixed size.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, table = random_rows(), np.zeros((BUCKETS, WIDTH), dtype=np.int64)
        for words, cuts in _joined(words_of(t for b in batches for t in b["_text"])):
            add_company(table, words, cuts, rows)
        used = np.flatnonzero(table.any(1))
        yield pd.DataFrame({"_bucket": used, **{f"_{k}": table[used, k] for k in range(WIDTH)}})

    names = [f"_{k}" for k in range(WIDTH)]
    partial = df.select("_text").mapInPandas(gather, ", ".join(["_bucket long", *(f"{n} long" for n in names)]))
    summed = partial.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    table = np.zeros((BUCKETS, WIDTH))
    table[summed["_bucket"].to_numpy()] = summed[names].to_numpy()
    return table


def _joined(groups: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of texts put together until they hold ``least`` words, so that few passes add to the table."""
    words, cuts, size = [], [np.zeros(1, np.int64)], 0
    for w, c in groups:
        words.append(w)
        cuts.append(np.asarray(c[1:]) + size)
        size += len(w)
        if size >= least:
            yield np.concatenate(words), np.concatenate(cuts)
            words, cuts, size = [], [np.zeros(1, np.int64)], 0
    if size:
        yield np.concatenate(words), np.concatenate(cuts)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit vectors of the word table, without what all words have in common."""
    unit = table / np.maximum(np.linalg.norm(table, axis=1), 1e-9)[:, None]
    used = table.any(1)
    if used.any():
        unit[used] -= unit[used].mean(0)
    return (unit / np.maximum(np.linalg.norm(unit, axis=1), 1e-9)[:, None]).astype(np.float32)


def pooled(words: np.ndarray, cuts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each text the means of its words' vectors, of their squares and of neighbours' products."""
    out = np.zeros((len(cuts) - 1, 3 * WIDTH), dtype=np.float32)
    block = 1 << 15
    for t in np.flatnonzero(np.diff(cuts) > block):  # a long text in blocks
        a, b = cuts[t], cuts[t + 1]
        for at in range(a, b, block):
            v = vectors[words[at : min(b, at + block + 1)]]
            own = v[: min(b, at + block) - at]
            out[t] += np.hstack([own.sum(0), (own * own).sum(0), (v[:-1] * v[1:]).sum(0)])
    short = np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) <= block))
    for at in range(0, len(short), 256):
        own = short[at : at + 256]
        sizes = cuts[own + 1] - cuts[own]
        starts = np.r_[0, np.cumsum(sizes)]
        v = vectors[words[np.repeat(cuts[own] - starts[:-1], sizes) + np.arange(starts[-1])]]
        products = np.zeros_like(v)
        products[:-1] = v[:-1] * v[1:]
        products[starts[1:] - 1] = 0  # the last word of a text has no neighbour in it
        for k, part in enumerate((v, v * v, products)):
            out[own, k * WIDTH : (k + 1) * WIDTH] = np.add.reduceat(part, starts[:-1], axis=0)
    n = np.maximum(np.diff(cuts), 1)[:, None].astype(np.float32)
    out[:, : 2 * WIDTH] /= n
    out[:, 2 * WIDTH :] /= np.maximum(n - 1, 1)
    return out


@dataclass
class Network:
    """Two layers over standardised features; the temperature divides the logit."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return np.tanh(x @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -50, 50)))


def fit(features: np.ndarray, labels: np.ndarray) -> Network:
    """Fit the layers by Adam on cross entropy, and the temperature on rows that the layers haven't seen."""
    features = features.astype(np.float64)
    order = np.arange(len(labels))
    apart = order % CALIBRATION == CALIBRATION - 1
    if len(set(labels[~apart])) < 2 or len(set(labels[apart])) < 2:
        apart = np.zeros(len(labels), dtype=bool)
    x, y = features[~apart], labels[~apart].astype(np.float64)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    random = np.random.default_rng(SEED)
    weights = [
        random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))),
    ]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    x = (x - centre) / scale
    for step in range(1, STEPS + 1):
        hidden = np.tanh(x @ weights[0] + weights[1])
        wrong = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -50, 50))) - y) / len(y)
        back = np.outer(wrong, weights[2]) * (1 - hidden**2)
        slopes = [x.T @ back + DECAY * weights[0], back.sum(0), hidden.T @ wrong + DECAY * weights[2], wrong.sum()]
        for w, slope, (m, v) in zip(weights, slopes, moments):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope**2 - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    network = Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3]))
    if apart.any():
        network.temperature = temperature(network.logits(features[apart]), labels[apart])
    return network


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature between 1/8 and 8 under which the labels are likeliest."""
    sign = np.where(labels > 0, 1.0, -1.0)
    tried = np.exp(np.linspace(-np.log(8), np.log(8), 241))
    loss = [np.logaddexp(0, -sign * logits / t).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def _features(df: DataFrame, vectors, keep: str) -> DataFrame:
    """The columns ``keep`` (a schema string) and ``_features``: the pooled vectors of ``_text``, packed."""
    names = [c.split()[0] for c in keep.split(", ")]

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for w, c in words_of(batch["_text"]) for r in pooled(w, c, vectors.value)]
            yield batch[names].assign(_features=[r.tobytes() for r in rows])

    return df.mapInPandas(pool, f"{keep}, _features binary")


def train(df: DataFrame, labels: DataFrame, learn: Column, vectors) -> Network | None:
    """Fit on the labelled rows of ``<_id, _text>`` where ``learn`` holds; None unless both labels occur.

    Labels are ``<_id, _label>`` with 0 or 1. Of each label the ``SAMPLE_ROWS / 2`` ids with the smallest
    hashes are taken, and of their documents the ``SAMPLE_ROWS`` with the smallest. Only these
    documents' pooled vectors go to the driver.
    """
    usable = labels.where(F.col("_label").isin(0, 1) & learn).select(
        F.col("_id"), F.col("_label").cast("int"), F.xxhash64("_id").alias("_hash")
    )
    usable = usable.distinct()
    sides = [usable.where(F.col("_label") == k).orderBy("_hash", "_id").limit(SAMPLE_ROWS // 2) for k in (0, 1)]
    # SAMPLE_ROWS rows at most
    rows = df.join(F.broadcast(sides[0].unionAll(sides[1])), "_id")
    packed = _features(rows.select("_label", "_hash", "_text"), vectors, "_label int, _hash long")
    found = packed.orderBy("_hash", "_label", "_features").limit(SAMPLE_ROWS).collect()
    known = np.array([r["_label"] for r in found], dtype=np.int64)
    if len(set(known.tolist())) < 2:
        return None
    features = np.frombuffer(b"".join(r["_features"] for r in found), dtype=np.float32)
    weight = usable.agg(F.avg("_label")).first()[0]
    return _shifted(fit(features.reshape(len(found), -1), known), known.mean(), weight)


def _shifted(network: Network, sampled: float, share: float) -> Network:
    """Scores for labels as frequent as they really are, where the sample was dealt otherwise."""
    odds = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    network.second_bias += float(odds) * network.temperature
    return network


def held_out(id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 0 modulo 5; null ids don't."""
    crc = F.crc32(F.col(id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(5)) == 0, F.lit(False))


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = 0.3,
) -> DataFrame:
    """``<id, held_out, score, predicted>`` of every row.

    ``labels`` holds ``id`` and ``label`` (0 or 1; others and null ids are left out). Word vectors are
    gathered from all texts, labels only from ids that aren't held out; labels are no input of a score.
    A null text is empty; a text without words is scored from vectors of zeros. Where the labels
    don't hold both values, every score is 0.5. Repeated rows stay as they are, rows with a null id are
    scored and never learned from, other columns aren't read. An empty table gives no rows.
    """
    rows = df.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    context = df.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(company(rows)))  # BUCKETS x WIDTH, whatever the corpus
    known = labels.select(F.col(id).alias("_id"), F.col(label).alias("_label"))
    network = context.broadcast(train(rows, known, ~held_out("_id") & F.col("_id").isNotNull(), vectors))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if network.value is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            found = [network.value.scores(pooled(w, c, vectors.value)) for w, c in words_of(texts)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    scored = rows.select("_id", score("_text").alias("score"))
    return scored.select(
        F.col("_id").alias(id),
        held_out("_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
