"""Dense retrieval: exact top-k for batches of questions, and cell-based approximate search.

Frames: ``questions<query_id, vector[, match]>``, ``corpus<item_id, vector[, match]>`` with
``array<double>`` vectors; hits are ``<query_id, item_id, score, rank>``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.operators.blocks import BATCH_ROWS, BIG_ROWS, apply_blocks
from quaero.operators.sizing import lookup_join, top_per_key

SCORE_DIGITS = 6
#: items that a task scores at once for all its questions
ROWS_AT_ONCE = 1024
HIT_SCHEMA = "query_id bigint, item_id bigint, score double"


def unit(vector: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    squares = F.aggregate(F.transform(vector, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(squares)
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def cosine(a: Column, b: Column) -> Column:
    """Dot product; the cosine for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _kernel(metric: str, k: int, matched: bool, skip_self: bool):
    """Score one block of questions against streamed corpus batches, keeping k per question."""

    def run(frames: Iterator[pd.DataFrame], questions: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if questions.empty:
            return
        q = np.stack(questions["vector"].to_numpy())
        q_ids = questions["query_id"].to_numpy()
        q_match = questions["match"].to_numpy() if matched else None
        asks_match = questions["match"].notna().to_numpy() if matched else None
        best_s = np.empty((len(q), 0))
        best_i = np.empty((len(q), 0), dtype=np.int64)
        for frame in (f.iloc[at : at + ROWS_AT_ONCE] for f in frames for at in range(0, len(f), ROWS_AT_ONCE)):
            c = np.stack(frame["vector"].to_numpy())
            ids = frame["item_id"].to_numpy()
            scores = q @ c.T
            if metric == "l2":
                squared = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * scores
                scores = -np.maximum(squared, 0.0)
            scores = np.round(scores, SCORE_DIGITS)
            if matched:
                other = q_match[:, None] != frame["match"].to_numpy()[None, :]
                scores[other & asks_match[:, None]] = -np.inf
            if skip_self:
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
            all_s = np.concatenate([best_s, scores], axis=1)
            all_i = np.concatenate([best_i, np.broadcast_to(ids, scores.shape)], axis=1)
            order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s = np.take_along_axis(all_s, order, axis=1)
            best_i = np.take_along_axis(all_i, order, axis=1)
        kept = np.isfinite(best_s)
        yield pd.DataFrame(
            {
                "query_id": np.repeat(q_ids, kept.sum(axis=1)),
                "item_id": best_i[kept],
                "score": best_s[kept] if metric != "l2" else -best_s[kept],
            }
        )

    return run


def vector_topk(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    matched: bool = False,
    skip_self: bool = False,
    batch_rows: int = BATCH_ROWS,
    big_rows: int = BIG_ROWS,
) -> DataFrame:
    """Exact top-k per question, ties by smaller item id.

    Each task keeps k hits per question while it streams its part of the corpus; only those are
    shuffled. ``matched=True`` restricts a question to items with an equal ``match`` value
    *before* ranking; a question whose value is null searches all items. ``metric="l2"`` ranks by
    smallest squared distance.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    columns = ["vector", "match"] if matched else ["vector"]
    asked = questions.select("query_id", *columns).dropna(subset=["vector"])
    found = apply_blocks(
        corpus.select("item_id", *columns).dropna(subset=["vector"]),
        asked,
        _kernel(metric, k, matched, skip_self),
        HIT_SCHEMA,
        batch_rows,
        big_rows,
    )
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return top_per_key(found, ["query_id"], [order, F.col("item_id")], k)


def match_file_items(
    question: DataFrame, chunks: DataFrame, file_ids: DataFrame, match_count: int | None = None
) -> DataFrame:
    """Chunks of the given files by similarity to each question, best ``match_count`` of them.

    ``chunks<item_id, file_id, vector>``; doubled file ids count once; no count means all rows.
    """
    inside = lookup_join(chunks, file_ids.select("file_id").distinct(), ["file_id"], "left_semi")
    if match_count is not None:
        return vector_topk(question, inside, match_count).withColumnRenamed("score", "similarity")

    def score_all(frames, questions):
        q = np.stack(questions["vector"].to_numpy())
        for frame in frames:
            if frame.empty:
                continue
            scores = np.round(q @ np.stack(frame["vector"].to_numpy()).T, SCORE_DIGITS)
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(questions["query_id"].to_numpy(), len(frame)),
                    "item_id": np.tile(frame["item_id"].to_numpy(), len(q)),
                    "score": scores.ravel(),
                }
            )

    return apply_blocks(
        inside.select("item_id", "vector"),
        question.select("query_id", "vector"),
        score_all,
        HIT_SCHEMA,
    ).withColumnRenamed("score", "similarity")


def hashed_vector(words: Column, dim: int = 64) -> Column:
    """Built-in embedder: unit vector of word counts hashed into ``dim`` places."""

    @F.arrow_udf("array<double>")
    def embed(rows: pa.Array) -> pa.Array:
        # each different word of a batch becomes a text of Python once
        coded = pc.list_flatten(rows).dictionary_encode()
        place = [int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % dim for word in coded.dictionary.to_pylist()]
        at = pc.list_parent_indices(rows).to_numpy(zero_copy_only=False).astype(np.int64) * dim
        at = at + np.array(place, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(at, minlength=len(rows) * dim).reshape(len(rows), dim).astype(float)
        norms = np.sqrt((counts * counts).sum(axis=1))
        held = norms > 0
        ends = np.concatenate([[0], np.cumsum(held) * dim]).astype(np.int32)
        values = counts[held] / norms[held][:, None]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~held))

    return embed(words)


def train_cells(corpus: DataFrame, cells: int = 100, seed: int = 42, steps: int = 20):
    """K-means cells over the corpus vectors."""
    features = corpus.select(array_to_vector("vector").alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=steps).fit(features)


def assign_cells(model, items: DataFrame) -> DataFrame:
    """Add the nearest ``cell``; write the result partitioned by it for pruned scans."""
    featured = items.withColumn("features", array_to_vector("vector"))
    return (
        model.transform(featured)
        .withColumnRenamed("prediction", "cell")
        .drop("features")
    )


def ann_topk(
    model, questions: DataFrame, celled: DataFrame, k: int = 10, probes: int = 8
) -> DataFrame:
    """Approximate top-k: a question is compared with the items of its ``probes`` nearest cells."""
    centres = np.array(model.clusterCenters())

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        q = np.stack(vectors.to_numpy())
        gaps = (centres * centres).sum(1)[None, :] - 2 * (q @ centres.T)
        return pd.Series(list(np.argsort(gaps, axis=1)[:, :probes].astype("int32")))

    probed = questions.select(
        "query_id",
        F.col("vector").alias("_q"),
        F.explode(nearest("vector")).alias("cell"),
    )
    pairs = lookup_join(celled.select("item_id", "vector", "cell"), probed, ["cell"])
    scored = pairs.select(
        "query_id", "item_id", F.round(cosine(F.col("_q"), F.col("vector")), SCORE_DIGITS).alias("score")
    )
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def recall_against(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact hits that the approximate search found, per question."""
    found = approximate.select("query_id", "item_id", F.lit(1.0).alias("found"))
    return (
        exact.join(found, ["query_id", "item_id"], "left")
        .groupBy("query_id")
        .agg(F.round(F.avg(F.coalesce("found", F.lit(0.0))), 6).alias("recall"))
    )
