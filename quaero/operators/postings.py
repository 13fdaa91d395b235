"""A stored BM25 index whose blocks are read only where a question's best items can be.

The rows that one task reads are cut into *ranges* of some thousand items. For each term of a range
there is one block: the places in the range of the items that hold the term, and how often they do. A row
for the range itself has the ids and lengths of its items. Above its items a block shows its skyline, the
pairs (occurrences, length) that no other pair of the block beats in both; whatever the corpus grows to
and whatever parameters a search has, the best weight in the block is that of a pair of the skyline.
Blocks are stored by bucket of their term, as bytes: most of them have one item, and every one is shuffled.

A search reads the skylines of its terms first. The bounds of a question's terms add up to what an
item of a range can reach at most. The ranges with the highest bounds are scored; the k-th score found
there is a threshold that the other ranges must be able to reach, or else their blocks are never
joined. What is scored is dealt out by range, and a range hands on the k best of each question. The result
is that of scoring all items, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as tx
from quaero.operators.lexical import SCORE_DIGITS, question_terms
from quaero.operators.sizing import fits, lookup_join, materialise, one_row, top_per_key
from quaero.options import Bm25Options

RANGE_ROWS = 4_096  # items of a range at most
RANGE_WORDS = 8_000_000  # ... and words, from which on a range ends
BUCKETS = 64
SPREAD = 8  # tasks that write one bucket, so that a common term's blocks are no single task
PROBED = 4  # ranges of a question that are scored to find its threshold
STATS = -1  # the bucket that holds how many items and words each range has

ASKS_AT_ONCE = 262_144  # terms of questions that one task scores in a range
PACKED_AT_ONCE = 131_072
ROWS_OUT = 65_536  # scored rows that a task holds at most before it hands them on

#: ``sky`` has pairs (occurrences, length), ``body`` pairs (places since the item before, occurrences). The row of a
#: range has no term: ``n`` are its items, ``body`` their ids and lengths, ``own`` its texts and words
_BLOCK = "term string, range long, n int, sky binary, body binary, own struct<texts: int, words: bigint>"


def packed(columns: tuple[np.ndarray, ...], offsets: np.ndarray) -> pa.BinaryArray:
    """Lists of rows of whole numbers from 0 on as bytes, seven bits each; the last byte of a number is below 128."""
    rows = len(columns[0])
    ends, parts = np.zeros(rows + 1, np.int32), []
    for at in range(0, rows, PACKED_AT_ONCE):
        values = np.column_stack([c[at : at + PACKED_AT_ONCE] for c in columns]).astype(np.int64).ravel()
        size = np.ones(len(values), np.int64)
        for bits in range(7, 63, 7):
            if (more := values >= 1 << bits).any():
                size += more
        upto = np.cumsum(size)
        out = np.empty(upto[-1], np.uint8)
        for i in range(size.max()):
            some = size > i
            out[(upto - size)[some] + i] = (values[some] >> 7 * i & 127) | np.where(size[some] > i + 1, 128, 0)
        own = upto[len(columns) - 1 :: len(columns)]
        ends[at + 1 : at + 1 + len(own)] = ends[at] + own
        parts.append(out)
    data = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets]), pa.py_buffer(data)])


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and where each list starts and the last one ends."""
    lists = lists.cast(pa.large_binary())
    at = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    ends = np.flatnonzero(data < 128)
    size = np.diff(ends, prepend=-1)
    values = np.zeros(len(ends), np.int64)
    for i in range(size.max(initial=0)):
        some = size > i
        values[some] |= (data[(ends - size + 1)[some] + i] & 127).astype(np.int64) << 7 * i
    return values, np.searchsorted(ends, at - at[0])


def _places(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and occurrences of all items of some blocks, and where each block starts."""
    values, offsets = unpacked(bodies)
    gaps, tf, offsets = values[::2], values[1::2], offsets // 2
    upto = np.cumsum(gaps)
    return upto - np.repeat(np.r_[0, upto][offsets[:-1]], np.diff(offsets)), tf, offsets


def _own_items(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of the items of a range."""
    n = len(body) // 12
    return np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i4", n, 8 * n)


def range_blocks(ids: np.ndarray, words: pa.ListArray, number: int) -> pa.RecordBatch:
    """The blocks of one range, by term, and a row without a term: its items, texts and words."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    terms = pc.list_flatten(words).dictionary_encode()
    counted = pa.table({"term": terms.indices, "doc": pc.list_parent_indices(words).cast(pa.int32())})
    terms = terms.dictionary
    counted = counted.group_by(["term", "doc"], use_threads=False).aggregate([([], "count_all")])
    code, doc, tf = (counted[c].to_numpy().astype(np.int32) for c in ("term", "doc", "count_all"))
    del counted
    order = np.lexsort((doc, code))
    code, doc, tf = code[order], doc[order], tf[order]
    length = lengths[doc]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    offsets = np.r_[first, len(code)]
    # in order of length, a pair is on the skyline if no shorter item holds the term as often
    by_length = np.lexsort((-tf, length, code))
    height = code[by_length].astype(np.int64) * (int(tf.max(initial=0)) + 1) + tf[by_length]
    shown = by_length[height > np.r_[-1, np.maximum.accumulate(height)[:-1]]] if len(code) else by_length
    sky = np.r_[0, np.cumsum(np.bincount(code[shown], minlength=len(first)))]
    n = len(first)
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    schema = pa.schema(
        [("term", terms.type), ("range", pa.int64()), ("n", pa.int32()), ("sky", pa.binary()), ("body", pa.binary()),
         ("own", pa.struct([("texts", pa.int32()), ("words", pa.int64())]))]
    )
    columns = [
        terms.take(pa.array(code[first])),
        pa.array(np.full(n, number)),
        pa.array(np.diff(offsets), pa.int32()),
        packed((tf[shown], length[shown]), sky),
        packed((gaps, tf), offsets),
        pa.nulls(n, schema.field("own").type),
    ]
    blocks = pa.RecordBatch.from_arrays(columns, schema=schema)
    items = ids.astype("<i8").tobytes() + lengths.astype("<i4").tobytes()
    texts = {"texts": len(words) - words.null_count, "words": int(lengths.sum())}
    own = [[None], [number], [len(words)], [b""], [items], [texts]]
    stats = pa.record_batch([pa.array(v, f.type) for v, f in zip(own, schema)], schema=schema)
    return pa.concat_batches([blocks, stats])


def write_index(
    items: DataFrame, path: str, buckets: int = BUCKETS, range_rows: int = RANGE_ROWS, append: bool = False
) -> None:
    """Store the index of ``items<item_id, text>``; ids are unique.

    One pass over the texts, then one shuffle of the blocks. ``append`` adds the ranges of further
    items to an index with the same number of buckets. Null texts count as items without words.
    """
    words = items.select(F.col("item_id").cast("long"), tx.tokens(F.lower("text")).alias("words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def blocks() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = rows["item_id"].combine_chunks().to_numpy(zero_copy_only=True)  # no id is null
            return range_blocks(ids, rows["words"].combine_chunks(), number)

        room, left = range_rows, RANGE_WORDS
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, room)
                at += len(part)
                room -= len(part)
                left -= len(pc.list_flatten(part.column(1)))
                held.append(part)
                if room <= 0 or left <= 0:
                    yield blocks()
                    pa.default_memory_pool().release_unused()  # the worker lives on: what a range took goes back
                    number, room, left = number + 1, range_rows, RANGE_WORDS
        if held:
            yield blocks()
            pa.default_memory_pool().release_unused()

    made = words.mapInArrow(cut, _BLOCK)
    if append:  # further ranges must not have the numbers of those that are there
        made = made.withColumn("range", F.col("range") + _next_range(items.sparkSession, path))
    bucket = F.when(F.col("term").isNull(), F.lit(STATS)).otherwise(term_bucket(F.col("term"), buckets))
    (
        made.withColumn("bucket", bucket)
        .repartition(F.col("bucket"), F.pmod(F.xxhash64("range"), F.lit(SPREAD)))
        .sortWithinPartitions("bucket", "term", "range")
        .write.mode("append" if append else "overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def _next_range(spark: SparkSession, path: str) -> int:
    """Behind the last range, at the next multiple of 2**32 tasks' worth."""
    last = spark.read.parquet(path).where(F.col("bucket") == STATS).agg(F.max("range")).first()[0]
    return ((last >> 32) + 1) << 32 if last is not None else 0


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class BlockIndex:
    """A stored index; ``buckets`` is what it was written with."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def stored(self, wanted: list[int]) -> DataFrame:
        """The rows of some buckets: whole folders of the others are not listed for the scan."""
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(wanted))

    def blocks(self, wanted: list[int]) -> DataFrame:
        """The blocks of some buckets with their items, occurrences and lengths as lists, to look into an index."""
        own = self.stored([STATS]).select("range", F.col("body").alias("own"))

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, tf, offsets = _places(batch["body"])
                ranges = [_own_items(own) for own in batch["own"].to_pylist()]
                parts = [slice(*x) for x in zip(offsets, offsets[1:])]
                lists = [
                    pa.array([ids[place[p]] for (ids, _), p in zip(ranges, parts)], pa.list_(pa.int64())),
                    pa.array([tf[p] for p in parts], pa.list_(pa.int32())),
                    pa.array([lengths[place[p]] for (_, lengths), p in zip(ranges, parts)], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=names)

        names = ["bucket", "term", "range", "n", "items", "tfs", "lengths"]
        rows = self.stored(wanted).where(F.col("bucket") != STATS).drop("own").join(own, "range")
        kinds = "bucket int, term string, range long, n int, items array<bigint>, tfs array<int>, lengths array<int>"
        return rows.select(*names[:4], "body", "own").mapInArrow(spell, kinds)

    def stats(self) -> DataFrame:
        """``<n, avgdl>`` of the corpus, from one row for each range, without its items."""
        return self.stored([STATS]).agg(
            F.sum("n").alias("n"), (F.sum("own.words") / F.sum("own.texts")).alias("avgdl")
        )


def _weight(tf, length, avgdl: float, o: Bm25Options):
    return tf * (o.k1 + 1) / (tf + o.k1 * (1 - o.b + o.b * length / avgdl))


def _score_ranges(k: int, options: Bm25Options, schema: pa.Schema):
    """Score the rows of ranges in order: the items of a range, its blocks, and the terms of each question.

    A task holds the blocks of one range, and of a question's items the ``k`` best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, lengths, avgdl, blocks = None, None, None, None, {}
        asking, terms, idfs = None, [], []
        done: list[tuple] = []

        def answer() -> None:
            met = [(*blocks[t], idf) for t, idf in zip(terms, idfs) if t in blocks]
            terms.clear(), idfs.clear()
            if not met:
                return
            place = np.concatenate([p for p, _, _ in met])
            scores = np.bincount(place, np.concatenate([w * idf for _, w, idf in met]), len(ids))
            held = np.flatnonzero(np.bincount(place, minlength=len(ids)))
            items, own = np.unique(ids[held], return_inverse=True)  # rows of one id add up
            scores = np.round(np.bincount(own, scores[held]), SCORE_DIGITS)
            if len(scores) > k:
                high = scores >= -np.partition(-scores, k - 1)[k - 1]
                items, scores = items[high], scores[high]
            best = np.lexsort((items, -scores))[:k]
            done.append(([asking] * len(best), items[best], scores[best]))

        def answers() -> pa.RecordBatch:
            columns = [[q for part in done for q in part[0]], *(np.concatenate([x[i] for x in done] or [[]]) for i in (1, 2))]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            keys = np.column_stack([batch[c].to_numpy() for c in ("range", "part", "kind")])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for start, end in zip(starts, np.r_[starts[1:], len(keys)]):
                rows, here, kind = batch.slice(start, end - start), tuple(keys[start, :2]), keys[start, 2]
                if here != at:
                    answer()
                    at, ids, asking, blocks = here, None, None, {}
                if kind == 0:
                    ids, lengths = _own_items(rows["body"][0].as_py())
                    avgdl = rows["value"][0].as_py()
                elif kind == 1:
                    place, tf, offsets = _places(rows["body"])
                    weight = _weight(tf, lengths[place], avgdl, options)
                    for i, term in enumerate(rows["term"].to_pylist()):
                        own = slice(offsets[i], offsets[i + 1])
                        blocks[term] = place[own], weight[own]
                else:
                    for query, term, idf in zip(*(rows[c].to_pylist() for c in ("query_id", "term", "value"))):
                        if query != asking:
                            answer()
                            asking = query
                        terms.append(term)
                        idfs.append(idf)
                if sum(len(x[0]) for x in done) >= ROWS_OUT:
                    yield answers()
        answer()
        yield answers()

    return run


@dataclass(frozen=True)
class Search:
    """One batch of questions against a stored index, step by step."""

    index: BlockIndex
    questions: DataFrame
    k: int = 10
    options: Bm25Options = Bm25Options()
    probed: int = PROBED

    def run(self) -> DataFrame:
        """``<query_id, item_id, score, rank>``: the best ``k`` items, ties by smaller item id."""
        return self.steps()[-1]

    def steps(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """``(bounds, first, rest, hits)``: bounds by question and range, the ranges that are scored first,
        those that are scored after them, and the result."""
        asked = question_terms(self.questions).withColumn("bucket", term_bucket(F.col("term"), self.index.buckets))
        few = fits(asked)
        wanted = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # ``buckets`` at most
        blocks = self.index.stored(wanted)
        stats = one_row(self.index.stats())
        keys = ["bucket", "term"]
        held = lookup_join(blocks, asked.select(*keys).distinct(), keys, "left_semi", small_fits=few)
        df = held.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = materialise(asked.join(df, "term").select("query_id", *keys, idf.alias("idf"), stats["avgdl"].alias("avgdl")))

        best = self._best(held.select(*keys, "range", "sky", stats["avgdl"].alias("avgdl")))
        if few:  # one row for each term is dealt out by range, instead of one for each question and task
            best = best.repartition("range")
        bounds = materialise(
            lookup_join(best, weighted, keys, small_fits=few)
            .groupBy("query_id", "range")
            .agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))
        )
        order = [F.col("bound").desc(), F.col("range")]
        first = top_per_key(bounds, ["query_id"], order, self.probed).select("query_id", "range")
        found = materialise(self._top(self._scored(blocks, weighted, first, few)))
        least = found.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
        # a range whose bound equals the threshold can still hold a tie; scores are rounded
        reach = F.col("least").isNull() | (F.col("bound") + 10.0**-SCORE_DIGITS >= F.col("least"))
        others = bounds.join(first, ["query_id", "range"], "left_anti")
        open_ = lookup_join(others, least, ["query_id"], "left", small_fits=few)
        rest = materialise(open_.where(reach).select("query_id", "range"))
        more = self._scored(blocks, weighted, rest, few)
        hits = self._top(found.drop("rank").unionByName(more))
        return bounds, first, rest, hits

    def _best(self, heads: DataFrame) -> DataFrame:
        """``<bucket, term, range, best>``: the best weight that an item of a block has."""
        options = self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                pairs, offsets = unpacked(batch["sky"])
                weight = _weight(pairs[::2], pairs[1::2], batch["avgdl"][0].as_py(), options)
                best = np.maximum.reduceat(weight, offsets[:-1] // 2)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best)], names=["bucket", "term", "range", "best"])

        return heads.mapInArrow(run, "bucket int, term string, range long, best double")

    def _scored(self, blocks: DataFrame, weighted: DataFrame, ranges: DataFrame, few: bool) -> DataFrame:
        """``<query_id, item_id, score>`` of the best items in some ranges of each question, ``k`` of each range."""
        keys = ["bucket", "term", "range"]
        wanted = lookup_join(ranges, weighted, ["query_id"], small_fits=few)
        # the questions of a range that many ask are dealt out in parts
        asks = wanted.groupBy("range").agg(F.ceil(F.count("*") / ASKS_AT_ONCE).cast("int").alias("parts"))
        few_ranges = fits(asks)
        needed = wanted.select(*keys).distinct()
        if few and not fits(needed):  # more ranges than can be told apart here: their questions tell which terms
            needed = weighted.select(*keys[:2]).distinct()
        met = lookup_join(blocks, needed, needed.columns, "left_semi", small_fits=few)

        def dealt(df: DataFrame) -> DataFrame:
            return lookup_join(df, asks, ["range"], small_fits=few_ranges)

        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        own = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")
        query_type = weighted.schema["query_id"].dataType
        nothing = {"term": F.lit(None).cast("string"), "query_id": F.lit(None).cast(query_type), "value": F.lit(None).cast("double"), "body": F.lit(None).cast("binary")}

        def rows(df: DataFrame, kind: int, part: Column, **columns: Column) -> DataFrame:
            shown = [c.alias(name) for name, c in {**nothing, **columns}.items()]
            return dealt(df).select("range", part.alias("part"), F.lit(kind).alias("kind"), *shown)

        stats = one_row(self.index.stats())
        items = rows(self.index.stored([STATS]), 0, every, value=stats["avgdl"], body=F.col("body"))
        found = rows(met, 1, every, term=F.col("term"), body=F.col("body"))
        asking = rows(wanted, 2, own, term=F.col("term"), query_id=F.col("query_id"), value=F.col("idf"))
        whole = items.unionByName(found).unionByName(asking)
        spark = self.index.spark
        out = f"query_id {query_type.simpleString()}, item_id bigint, score double"
        kernel = _score_ranges(self.k, self.options, spark.createDataFrame([], out).toArrow().schema)
        sorted_rows = whole.repartition("range", "part").sortWithinPartitions("range", "part", "kind", "query_id")
        scored = sorted_rows.mapInArrow(kernel, out)
        return scored.groupBy("query_id", "item_id").agg(F.round(F.sum("score"), SCORE_DIGITS).alias("score"))

    def _top(self, scored: DataFrame) -> DataFrame:
        return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("item_id")], self.k)
