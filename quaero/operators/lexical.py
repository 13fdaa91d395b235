"""BM25 over an inverted index held as tables.

``postings<term, item_id, tf, length>``, ``terms<term, df>`` and corpus statistics. Questions are
``<query_id, text>``; hits are ``<query_id, item_id, score, rank>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quaero.functions import text as tx
from quaero.operators.sizing import fits, items_of_hits, lookup_join, one_row, top_per_key
from quaero.options import Bm25Options

SCORE_DIGITS = 6
#: words, and (item, question) scores, that a task holds at once
WORDS_AT_ONCE = 131_072
SCORES_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class LexicalIndex:
    """``words`` are the split items that the tables were made of, if they are at hand, and ``wanted``
    the terms that the postings were restricted to."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    words: DataFrame | None = None
    wanted: DataFrame | None = None

    def write(self, path: str, partitions: int = 64) -> None:
        """Persist, postings clustered by term bucket so that a few terms read a few files."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(partitions)).cast("int")
        # a second key keeps a hot term from landing in one task
        spread = F.pmod(F.xxhash64("item_id"), F.lit(16))
        (
            self.postings.withColumn("bucket", bucket)
            .repartition(F.col("bucket"), spread)
            .sortWithinPartitions("bucket", "term")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{path}/postings")
        )
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark, path: str) -> LexicalIndex:
        return LexicalIndex(
            spark.read.parquet(f"{path}/postings").drop("bucket"),
            spark.read.parquet(f"{path}/terms"),
            spark.read.parquet(f"{path}/stats"),
        )


def question_terms(questions: DataFrame) -> DataFrame:
    """Distinct terms per question."""
    words = F.array_distinct(tx.tokens(F.lower("text")))
    return questions.select("query_id", F.explode(words).alias("term"))


def split_items(items: DataFrame) -> DataFrame:
    """Texts split into word arrays: ``<item_id[, match], words>``."""
    carried = ["match"] if "match" in items.columns else []
    return items.select("item_id", *carried, tx.tokens(F.lower("text")).alias("words"))


def build_index(
    items: DataFrame, only_terms: DataFrame | None = None, few_terms: bool | None = None
) -> LexicalIndex:
    """Postings and statistics of ``items<item_id, text[, match]>`` or of split items.

    Words are counted in the task that reads their text; what is shuffled is one narrow row for each
    term of an item, and one with an empty term for the item itself, which the corpus statistics are
    made of. All parts of the index read the same exchange. ``only_terms<term>`` keeps just the
    postings of those terms (``few_terms``: they were found small enough to broadcast); lengths and
    document counts always cover the whole corpus. A ``match`` column (a metadata value to filter
    by) is carried into the postings.
    """
    carried = ["match"] if "match" in items.columns else []
    words = items if "words" in items.columns else split_items(items)
    length = F.size("words").cast("bigint")
    wanted = None
    # the empty word stands for the item: it is never null, so no part of the plan filters for that
    marked = F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(F.lit("")))
    exploded = words.select("item_id", *carried, length.alias("length"), F.explode(marked).alias("term"))
    if only_terms is not None:
        wanted = only_terms.select("term").distinct()
        if few_terms is None:
            few_terms = fits(wanted)
        if few_terms:
            every = wanted.unionByName(wanted.sparkSession.createDataFrame([("",)], "term string"))
            exploded = exploded.join(F.broadcast(every), ["term"], "left_semi")
        else:
            kept = lookup_join(exploded.filter("term <> ''"), wanted, ["term"], "left_semi", small_fits=False)
            exploded = kept.unionByName(exploded.filter("term = ''"))
    # told apart by an aggregate, for a filter on the key would go below the exchange and part the plans
    counted = exploded.groupBy("item_id", *carried, "term", "length").agg(
        F.count("*").alias("tf"), F.max(F.col("term") == "").alias("_item")
    )
    postings = counted.filter(~F.col("_item")).drop("_item")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    rows = counted.filter("_item")
    stats = rows.agg(F.sum("tf").alias("n"), (F.sum(F.col("length") * F.col("tf")) / F.sum(F.when(F.col("length").isNotNull(), F.col("tf")))).alias("avgdl"))
    return LexicalIndex(postings, terms, stats, words, wanted)


def _counted_once(words: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Items whose id is there once, and the others (null, or several rows: their words add up), if any."""
    copies = words.groupBy("item_id").agg(F.count("*").alias("_n"))
    repeated = copies.filter((F.col("_n") > 1) | F.col("item_id").isNull()).select("item_id")
    if repeated.isEmpty():
        return words, None
    few = fits(repeated)
    named = repeated.dropna()
    once = lookup_join(words.dropna(subset=["item_id"]), named, ["item_id"], "left_anti", small_fits=few)
    again = lookup_join(words, named, ["item_id"], "left_semi", small_fits=few)
    return once, again.unionByName(words.filter(F.col("item_id").isNull()))


def _kernel(asked: list, terms: dict, stats: tuple, k: int, options: Bm25Options, matched: bool, schema: pa.Schema):
    """Score the items of a task for all questions as they come, keeping k per question.

    ``asked`` holds ``(query_id, term[, match])``, ``terms`` the idf of the terms that occur.
    """
    ids = list(dict.fromkeys(row[0] for row in asked))
    place = {query: i for i, query in enumerate(ids)}
    order = sorted((row for row in asked if row[1] in terms), key=lambda row: row[1])
    names = list(dict.fromkeys(row[1] for row in order))
    number = {term: i for i, term in enumerate(names)}
    q_of = np.array([place[row[0]] for row in order], dtype=np.int64)
    n_of = np.bincount([number[row[1]] for row in order], minlength=len(names)).astype(np.int64)
    first = np.cumsum(n_of) - n_of
    idf = np.array([terms[term] for term in names])
    values = list(dict.fromkeys(row[2] for row in order if row[2] is not None)) if matched else []
    value_place = {value: i for i, value in enumerate(values)}
    wants = np.array([-1 if row[2] is None else value_place[row[2]] for row in order]) if matched else None
    avgdl = stats[1]
    most = max(1, SCORES_AT_ONCE // max(len(ids), len(order), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        best_q, best_i, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bound = np.full(len(ids), -np.inf)
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole["words"]), 0).to_numpy(zero_copy_only=False)
            at, upto = 0, np.cumsum(sizes)
            while at < len(sizes):
                # at least one item, few words and few scores at once
                room = np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS_AT_ONCE, side="right")
                to = min(max(int(room), at + 1), at + most)
                batch, length = whole.slice(at, to - at), sizes[at:to].astype(float)
                n, at = to - at, to
                words = pc.list_flatten(batch["words"])
                term = pc.fill_null(pc.index_in(words, known.cast(words.type)), -1).to_numpy(zero_copy_only=False)
                rows = pc.list_parent_indices(batch["words"]).to_numpy(zero_copy_only=False)
                key, tf = np.unique((rows.astype(np.int64) * len(names) + term)[term >= 0], return_counts=True)
                if not len(key):
                    continue
                row, term = np.divmod(key, len(names))
                damping = 1 - options.b + options.b * length[row] / avgdl
                weight = idf[term] * (tf * (options.k1 + 1)) / (tf + options.k1 * damping)
                # one pair for each question that has the term
                repeats = n_of[term]
                inside = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
                slot, row, weight = np.repeat(first[term], repeats) + inside, np.repeat(row, repeats), np.repeat(weight, repeats)
                if matched:
                    own = pc.fill_null(pc.index_in(batch["match"], pa.array(values, batch["match"].type)), -2)
                    own = own.to_numpy(zero_copy_only=False)
                    kept = (wants[slot] < 0) | (wants[slot] == own[row])
                    slot, row, weight = slot[kept], row[kept], weight[kept]
                pair = q_of[slot] * n + row
                scores = np.bincount(pair, weight, len(ids) * n)
                met = np.bincount(pair, minlength=len(ids) * n) > 0
                scores = np.round(scores, SCORE_DIGITS).reshape(len(ids), n)
                q, r = np.nonzero(met.reshape(len(ids), n) & (scores >= bound[:, None]))
                items = batch["item_id"].cast(pa.int64()).to_numpy(zero_copy_only=False)
                best_q, best_i = np.concatenate([best_q, q]), np.concatenate([best_i, items[r]])
                best_s = np.concatenate([best_s, scores[q, r]])
                ranked = np.lexsort((best_i, -best_s, best_q))
                best_q, best_i, best_s = best_q[ranked], best_i[ranked], best_s[ranked]
                rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
                last = rank == k - 1
                bound[best_q[last]] = best_s[last]
                kept = rank < k
                best_q, best_i, best_s = best_q[kept], best_i[kept], best_s[kept]
        columns = [pa.array([ids[q] for q in best_q], schema.field(0).type), pa.array(best_i).cast(schema.field(1).type), pa.array(best_s)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _topk_of_texts(questions: DataFrame, asked: DataFrame, index: LexicalIndex, k: int, options: Bm25Options, matched: bool) -> DataFrame:
    """Few questions: their terms go to every task, which scores its items whole and shuffles only its best.

    A first pass counts the documents of each term. Items of one id in several rows take the way over postings.
    """
    once, again = _counted_once(index.words)
    if index.wanted is not None:
        asked = asked.join(F.broadcast(index.wanted), "term", "left_semi").select(asked.columns)
    wanted = asked.select("term").distinct()
    every = F.broadcast(wanted.unionByName(wanted.sparkSession.createDataFrame([("",)], "term string")))
    marked = F.concat(F.array_distinct(F.coalesce("words", F.array().cast("array<string>"))), F.array(F.lit("")))
    each = once.select(F.size("words").cast("bigint").alias("length"), F.explode(marked).alias("term")).join(every, "term", "left_semi")
    counts = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("sum"), F.count("length").alias("n"))
    rest = None
    if again is not None:
        rest = build_index(again, wanted, True)
        words = again.select(F.lit("").alias("term"), F.lit(1).cast("bigint").alias("df"), F.size("words").cast("bigint").alias("sum"))
        words = words.groupBy("term").agg(F.sum("df").alias("df"), F.sum("sum").alias("sum"), F.count("sum").alias("n"))
        zero = F.lit(0).cast("bigint")
        counts = counts.unionByName(words).unionByName(rest.terms.select("term", "df", zero.alias("sum"), zero.alias("n")))
        counts = counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "sum", "n")])
    found = {row["term"]: row for row in counts.collect()}
    total = found.pop("", None)
    n = total["df"] if total else 0
    avgdl = total["sum"] / total["n"] if total and total["n"] else None
    terms = {term: float(np.log(1 + (n - row["df"] + 0.5) / (row["df"] + 0.5))) for term, row in found.items()}
    rows = asked.join(questions.select("query_id", "match"), "query_id") if matched else asked
    types = {field.name: field.dataType for field in asked.schema} | {"item_id": once.schema["item_id"].dataType}
    spark = wanted.sparkSession
    schema = spark.createDataFrame([], f"query_id {types['query_id'].simpleString()}, item_id {types['item_id'].simpleString()}, score double").schema
    kernel = _kernel([tuple(row) for row in rows.select("query_id", "term", *(["match"] if matched else [])).collect()], terms, (n, avgdl), k, options, matched, spark.createDataFrame([], schema).toArrow().schema)
    scored = once.select("item_id", *(["match"] if matched else []), "words").mapInArrow(kernel, schema)
    if rest is not None:
        df = rest.postings.sparkSession.createDataFrame([(t, r["df"]) for t, r in found.items()], "term string, df bigint")
        stats = spark.createDataFrame([(n, avgdl)], "n bigint, avgdl double")
        general = _scores(questions, asked, LexicalIndex(rest.postings, df, stats), True, options, matched)
        scored = scored.unionByName(general)
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def bm25_topk(
    questions: DataFrame,
    index: LexicalIndex,
    k: int = 10,
    options: Bm25Options = Bm25Options(),
    matched: bool = False,
) -> DataFrame:
    """Best k items per question by BM25, ties by smaller item id.

    ``matched=True`` ranks only items whose ``match`` value equals that of the question; a question
    whose value is null searches all items.
    """
    asked = question_terms(questions)
    few = fits(asked)
    if few and index.words is not None and isinstance(index.words.schema["item_id"].dataType, IntegralType):
        return _topk_of_texts(questions, asked, index, k, options, matched)
    scored = _scores(questions, asked, index, few, options, matched)
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def _scores(questions: DataFrame, asked: DataFrame, index: LexicalIndex, few: bool, options: Bm25Options, matched: bool) -> DataFrame:
    """``<query_id, item_id, score>`` of every item that has a term of the question, over postings."""
    stats = one_row(index.stats)
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if few:
        weighted = index.terms.join(F.broadcast(asked), "term")
    else:
        # many questions: one of their terms may be hot, the vocabulary has each term once
        weighted = lookup_join(asked, index.terms, ["term"], small_fits=False)
    weighted = weighted.select("query_id", "term", idf.alias("idf"))
    if matched:
        weighted = weighted.join(questions.select("query_id", "match"), "query_id")
        free = weighted.filter(F.col("match").isNull()).drop("match")
        postings = index.postings.drop("match")
        inside = lookup_join(index.postings, weighted.dropna(subset=["match"]), ["term", "match"], small_fits=few)
        pairs = inside.drop("match").unionByName(lookup_join(postings, free, ["term"], small_fits=few))
    else:
        pairs = lookup_join(index.postings, weighted, ["term"], small_fits=few)
    tf = F.col("tf")
    damping = 1 - options.b + options.b * F.col("length") / stats["avgdl"]
    weight = F.col("idf") * (tf * (options.k1 + 1)) / (tf + options.k1 * damping)
    return pairs.groupBy("query_id", "item_id").agg(F.round(F.sum(weight), SCORE_DIGITS).alias("score"))


def keep_matching(hits: DataFrame, items: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Metadata equality applied to ranked hits; may leave fewer than k per question.

    ``items<item_id, match>``, ``questions<query_id, match>``; the order of the rest is kept. A
    question whose value is null keeps all its hits.
    """
    few = fits(questions)
    wanted = questions.select("query_id", "match")
    labelled = lookup_join(hits.filter(F.col("rank") <= k), wanted, ["query_id"], small_fits=few)
    asking = labelled.dropna(subset=["match"])
    kept = items_of_hits(items.select("item_id", "match"), asking, ["item_id", "match"], few)
    columns = ["query_id", "item_id", "score", "rank"]
    free = labelled.filter(F.col("match").isNull())
    kept = kept.select(columns).unionByName(free.select(columns)).withColumnRenamed("rank", "before")
    ranked = top_per_key(kept, ["query_id"], [F.col("before")], k)
    return ranked.select("query_id", "item_id", "score", "rank")
