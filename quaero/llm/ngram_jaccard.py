"""All documents whose word-shingle sets are alike, as groups linked by exact Jaccard similarity.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most (a + b)(1 - t)/(1 + t)
shingles. For each band of sizes the universe of shingles is hashed into more segments than that,
so a similar pair agrees in whole segments: segment subsets are the index. Segments are dear when
many documents share them, which is when they hold nothing but common shingles (or nothing). How they are
used is allocated by cost:

* a document with no more dear segments than the band has to spare leaves them out: the others
  still outnumber the differences;
* a document with more of them makes up for each with the one-deletion neighbourhood of the others,
  which finds a segment that differs in one shingle and so is worth two;
* only where that isn't enough (hardly anything but common shingles) the dear ones are used.

Which shingles are common comes from a bounded sample; it decides the cost, never the result. Equal
sets are one class from the start. Classes that meet in a segment are verified exactly, first with
the best connected classes they meet, in a few rounds; what is then in one component needs no
further pair, and the rest is met pair by pair, as far as sizes and odd sketches allow the pair to be
similar at all. A sketch holds, for each of its bits, whether an odd number of the set's shingles fall
on it: every shingle that only one of two sets holds turns one bit, so two sets differ in no fewer
shingles than their sketches differ in bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import cut_lineage, fresh_name, lean, whole_text
from quaero.llm.components import connected_components
from quaero.llm.words import hashed_shingles, mix

SHINGLE = 5
PERCENT = 80  # similarity of a link, in percent
BAND = 1.5  # sizes of a band: from one bound to that times BAND
SAMPLE_ROWS = 8_192  # documents that common shingles are counted in
COMMON_SHARE = 0.005  # ... in so many of them or more
SKETCH = 16  # 64-bit words of a set's odd sketch
SLICE_ROWS = 500  # texts whose sets are held in a task's memory together
ROUNDS = 1  # of meeting the best connected classes before the rest is met pair by pair
CENTRES = 2  # ... so many of them a round
BROADCAST_ROWS = 1_000_000  # ids (8 bytes each) that may be shipped to all tasks
_SEGMENT = np.uint64(0xD6E8FEB86659FD93)  # fixed value: tells segments of different bands apart


@cache
def bounds(percent: int) -> list[int]:
    """Sizes where bands begin, as far as 2**40 shingles."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * max(BAND, 100 / percent + 0.01))))
    return out


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """``(band, segments, segments to spare)`` that a set of n shingles takes part in.

    Pairs inside a band of sizes, and pairs across each bound that a similar partner may lie beyond.
    """
    starts = bounds(percent)
    k = int(np.searchsorted(starts, n, "right")) - 1
    out = []

    def add(band: int, total: int) -> None:
        differ = total * (100 - percent) // (100 + percent)
        if differ:  # else only equal sets are similar
            spare = 1 + differ // 10
            out.append((band, differ + 1 + spare, spare))

    low, high = starts[k], starts[k + 1]
    add(2 * k, 2 * (high - 1))
    if 100 * n >= percent * high:  # the smaller one of a pair across the upper bound
        add(2 * k + 1, (high - 1) + 100 * (high - 1) // percent)
    if k and percent * n <= 100 * (low - 1):  # the larger one of a pair across the lower bound
        add(2 * k - 1, (low - 1) + 100 * (low - 1) // percent)
    return out


def signatures(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set of shingle hashes, by the allocation above."""
    keys = []
    mixed = mix(tokens)
    dear = _among(tokens, common)
    for band, m, spare in bands(len(tokens), percent):
        segment = ((mixed >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order].astype(np.int64), mixed[order]
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        sums, at = np.add.reduceat(value, first), segment[first]
        rare = np.add.reduceat(~dear[order], first, dtype=np.int64)  # rare shingles of each segment
        cheap, worth_two = rare > 0, rare > 1
        salt = (np.arange(m, dtype=np.uint64) + np.uint64(band << 32)) * _SEGMENT
        keys.append(mix(sums[cheap] + salt[at[cheap]]))
        n_cheap = int(cheap.sum())
        if m - n_cheap > spare:  # too many dear segments: one-deletion neighbourhoods of the others
            # (of those that stay cheap without any one shingle, so that the partner's is used too)
            who = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(value)]))
            some = worth_two[who]
            keys.append(mix(sums[who[some]] - value[some] + salt[segment[some]]))
            if n_cheap + int(worth_two.sum()) < m - spare:
                whole = np.zeros(m, dtype=np.uint64)  # empty segments too
                whole[at] = sums
                left = np.ones(m, dtype=bool)
                left[at[cheap]] = False
                keys.append(mix(whole[left] + salt[left]))
    return np.unique(np.concatenate(keys)) if keys else tokens[:0]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def class_of(tokens: np.ndarray) -> int:
    """An id of the set: equal sets have equal ids, others differ but for a chance of n*n / 2**65."""
    total = mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64))
    return int(total.view(np.int64)[0])


def _described(rows: DataFrame, size: int) -> DataFrame:
    """``<_id, _key, _n, _class, _odd>``: a document's set in short; no class without a shingle."""

    @lean
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, sketches = [], [], []
            for sh in hashed_shingles(batch.column(2).to_pylist(), size):
                tokens = np.unique(sh)
                n.append(len(tokens))
                classes.append(class_of(tokens) if len(tokens) else None)
                sketches.append(odd_sketch(tokens))
            flat = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64), pa.int64())
            offsets = pa.array(np.arange(len(n) + 1) * SKETCH, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                ["_id", "_key", "_n", "_class", "_odd"],
            )

    schema = "_id long, _key long, _n long, _class long, _odd array<bigint>"
    return rows.select("_id", "_key", "_text").mapInArrow(describe, schema)


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """The sketch of a set: for each bit, whether an odd number of shingles fall on it."""
    places = (mix(tokens) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def common_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles of many documents, from a sample of at most ``SAMPLE_ROWS`` different ones."""
    every = max(1, rows.count() // SAMPLE_ROWS)
    sample = rows.select("_text").where(F.pmod(F.xxhash64("_text"), F.lit(every)) == 0).limit(SAMPLE_ROWS)

    @lean
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sh in hashed_shingles(batch["_text"], size):
                yield pd.DataFrame({"h": np.unique(sh).view(np.int64)})

    sample = cut_lineage(sample.distinct())
    least = max(20, int(COMMON_SHARE * sample.count()))
    counts = sample.mapInPandas(emit, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # at most 1 / COMMON_SHARE times the shingles of a document
    found = [r["h"] for r in counts.where(F.col("n") >= least).select("h").collect()]
    return np.sort(np.array(found, dtype=np.int64).view(np.uint64))


def _keys(rows: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """``<_key, _class>``: the index keys of each class, once in each task that meets it."""
    shipped = rows.sparkSession.sparkContext.broadcast(common)

    @lean
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for texts in _slices(b["_text"] for b in batches):
            keys, classes = [], []
            for sh in hashed_shingles(texts, size):
                tokens = np.unique(sh)
                if not len(tokens) or (c := class_of(tokens)) in seen:
                    continue
                seen.add(c)
                own = signatures(tokens, shipped.value, percent)
                keys.append(own)
                classes.append(np.full(len(own), c, dtype=np.int64))
            if keys:
                yield pd.DataFrame({"_key": np.concatenate(keys).view(np.int64), "_class": np.concatenate(classes)})

    return rows.select("_text").mapInPandas(emit, "_key long, _class long")


def _slices(columns: Iterator) -> Iterator:
    """Columns of texts in pieces, for what is made of a piece is held in memory at once."""
    for column in columns:
        for at in range(0, len(column), SLICE_ROWS):
            yield column[at : at + SLICE_ROWS]


def _tokens(rows: DataFrame, size: int) -> DataFrame:
    """``<_class, _tokens>``: the sets themselves."""

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _slices(b.column(0) for b in batches):
            sets = [np.unique(sh) for sh in hashed_shingles(texts.to_pylist(), size)]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))],
                ["_class", "_tokens"],
            )

    return rows.select("_text").mapInArrow(emit, "_class long, _tokens array<bigint>")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Necessary for a link: the sizes fit, and the sketches don't differ too much."""
    total = F.col(f"{a}._n") + F.col(f"{b}._n")
    small, large = F.least(f"{a}._n", f"{b}._n"), F.greatest(f"{a}._n", f"{b}._n")
    words = [F.bit_count(F.col(f"{a}._odd")[k].bitwiseXOR(F.col(f"{b}._odd")[k])) for k in range(SKETCH)]
    return (100 * small >= percent * large) & ((100 + percent) * sum(words, F.lit(0)) <= (100 - percent) * total)


def _links(pairs: DataFrame, rows: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``<a, b>`` of classes that are similar, by their whole sets."""
    pairs = cut_lineage(pairs)
    classes = pairs.select(F.col("a").alias("_class")).union(pairs.select("b")).distinct()
    ids = cut_lineage(reps.select("_class", "_id").join(classes, "_class"))
    known = ids.select(F.col("_id").alias("_known"))
    if ids.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    texts = rows.join(known, F.col("_id").eqNullSafe(F.col("_known")), "left_semi")
    # several rows may have the id of a class: only those of the class itself count, once
    sets = _tokens(texts, size).join(ids.select("_class"), "_class", "left_semi").dropDuplicates(["_class"])
    first = sets.withColumnsRenamed({"_class": "a", "_tokens": "_ta"})
    second = sets.withColumnsRenamed({"_class": "b", "_tokens": "_tb"})
    met = pairs.join(first, "a").join(second, "b")
    shared = F.size(F.array_intersect("_ta", "_tb"))
    union = F.size("_ta") + F.size("_tb") - F.col("_s")
    return met.withColumn("_s", shared).where(100 * F.col("_s") >= percent * union).select("a", "b")


def _labelled(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """``<_id, _key, _n, _label>``: rows are linked, step by step, if labels are equal and not null."""
    docs = cut_lineage(_described(rows, size))
    reps = docs.where(F.col("_class").isNotNull()).groupBy("_class").agg(
        F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.first("_odd").alias("_odd")
    )
    labels = _components(rows, cut_lineage(reps), size, percent)
    return docs.drop("_odd").join(labels, "_class", "left").select(
        "_id", "_key", "_n", F.coalesce("_label", "_class").alias("_label")
    )


def _rows(df: DataFrame, id: str, text: str) -> DataFrame:
    body = whole_text(text)
    return df.select(F.col(id).cast("long").alias("_id"), F.xxhash64(body).alias("_key"), body.alias("_text"))


def jaccard_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``<id, n_shingles, component_id>`` of every row; ids are integers.

    A-Z count as a-z. A text of fewer words than a shingle has all its words as its only shingle; a
    text without words, or null, has none and is linked with nothing: its component is its own id.
    A null id is no smallest id; a component without any other id has null. Rows may repeat. Other
    columns are not read.
    """
    found = cut_lineage(_labelled(_rows(df, id, text), size, percent))
    linked = found.where(F.col("_label").isNotNull())
    least = linked.groupBy("_label").agg(F.min("_id").alias("_component"))
    whole = linked.join(least, "_label").select("_id", "_n", "_component")
    alone = found.where(F.col("_label").isNull()).select("_id", "_n", F.col("_id").alias("_component"))
    return whole.unionByName(alone).select(
        F.col("_id").alias(id), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id")
    )


def first_of_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """All columns of one row of each group: the one with the smallest id (null ids come last).

    Of rows that are equal in id and text one stays. Rows without words are no group and all stay.
    """
    found = cut_lineage(_labelled(_rows(df, id, text), size, percent))
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_key").alias("k"))
    first = found.where(F.col("_label").isNotNull()).groupBy("_label").agg(F.min(place).alias("_p"))
    alone = found.where(F.col("_label").isNull()).select(place.alias("_p")).distinct()
    kept = cut_lineage(first.select("_p").union(alone).select(F.col("_p.i").alias("_i"), F.col("_p.k").alias("_k")))
    own, key, i, k = (fresh_name(df, name) for name in ("_own", "_key", "_i", "_k"))
    marked = df.withColumns({own: F.col(id).cast("long"), key: F.xxhash64(whole_text(text))})
    kept = kept.select(F.col("_i").alias(i), F.col("_k").alias(k))
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    out = marked.join(kept, F.col(own).eqNullSafe(F.col(i)) & (F.col(key) == F.col(k)), "left_semi")
    repeated = found.where(F.col("_label").isNotNull()).groupBy("_id", "_key").count().where("count > 1")
    if not repeated.isEmpty():
        worded = F.length(F.btrim(whole_text(text), F.lit(" \t\n\x0b\f\r"))) > 0
        out = out.where(worded).dropDuplicates([own, key]).unionByName(out.where(~worded))
    return out.select(*df.columns)


def _components(rows: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """``<_class, _label>`` of all classes that are linked with another one."""
    common = common_shingles(rows, size)
    bucket = Window.partitionBy("_key")
    keys = _keys(rows, size, percent, common).withColumns(
        {"_first": F.min("_class").over(bucket), "_last": F.max("_class").over(bucket)}
    )
    shared = cut_lineage(keys.where(F.col("_first") < F.col("_last")).select("_key", "_class").distinct())
    # a class that meets many others is near the origin of its copies
    met = shared.withColumn("_met", F.count(F.lit(1)).over(bucket)).groupBy("_class").agg(F.sum("_met").alias("_weight"))
    shared = cut_lineage(shared.join(met, "_class"))
    links, labels = None, None
    for _ in range(ROUNDS):
        pairs = _may_linked(_with_centres(_labelled_keys(shared, labels)), reps, percent)
        found = _links(pairs, rows, reps, size, percent)
        links = cut_lineage(found if links is None else links.union(found))
        labels = connected_components(links)

    # segments that still hold several components: every pair across them that may be similar
    labelled = _labelled_keys(shared, labels).withColumns(
        {"_low": F.min("_label").over(bucket), "_high": F.max("_label").over(bucket)}
    )
    open_ = labelled.where(F.col("_low") < F.col("_high")).select("_key", "_class", "_label")
    open_ = cut_lineage(open_.join(reps.select("_class", "_n", "_odd"), "_class"))
    x, y = open_.alias("x"), open_.alias("y")
    across = x.join(
        y,
        (F.col("x._key") == F.col("y._key"))
        & (F.col("x._class") < F.col("y._class"))
        & (F.col("x._label") != F.col("y._label"))
        & _may_link("x", "y", percent),
    )
    pairs = across.select(F.col("x._class").alias("a"), F.col("y._class").alias("b")).distinct()
    every = connected_components(links.union(_links(pairs, rows, reps, size, percent)))
    return every.select(F.col("node").alias("_class"), F.col("label").alias("_label"))


def _labelled_keys(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``shared`` with the ``_label`` of the component that a class is in so far."""
    if labels is None:
        return shared.withColumn("_label", F.col("_class"))
    named = labels.select(F.col("node").alias("_class"), F.col("label").alias("_new"))
    return shared.join(named, "_class", "left").withColumn("_label", F.coalesce("_new", "_class")).drop("_new")


def _with_centres(labelled: DataFrame) -> DataFrame:
    """Pairs ``<a, b>`` of a class and the best connected classes of other components that it meets."""
    bucket = Window.partitionBy("_key")
    own = F.struct("_weight", "_class", "_label")
    out = labelled.withColumn("_one", F.max(own).over(bucket))
    other = F.when(F.col("_label") != F.col("_one._label"), own)
    out = out.withColumn("_two", F.max(other).over(bucket))
    centre = F.when(F.col("_label") != F.col("_one._label"), F.col("_one")).otherwise(F.col("_two"))
    met = out.select(F.col("_class").alias("a"), centre["_class"].alias("b")).where(F.col("b").isNotNull())
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_shared"))
    order = Window.partitionBy("a").orderBy(F.desc("_shared"), "b")
    some = met.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= CENTRES)
    return some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _may_linked(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    own = reps.select("_class", F.struct("_n", "_odd").alias("x"))
    out = pairs.join(own.withColumnsRenamed({"_class": "a", "x": "_xa"}), "a")
    out = out.join(own.withColumnsRenamed({"_class": "b", "x": "_xb"}), "b")
    return out.where(_may_link("_xa", "_xb", percent)).select("a", "b")
