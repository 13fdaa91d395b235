"""Find known metadata values in questions: substring, then word overlap, then fuzzy windows.

``questions<query_id, text>`` and ``values<value>``; a match is ``<query_id, value, score>``.
Candidates come from equi joins on words, word endings, character runs or letters, never from all pairs.

The fuzzy tier compares a value with windows of a question by their matching blocks. What a wanted
similarity says of these blocks makes an index that loses no pair (:func:`run_plan`): few characters
may be left over, few left over means few blocks, and few blocks means that one of any so many
character runs of the value stands in the question. The rarest runs of each value are its keys.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions import text as tx
from quaero.operators.blocks import apply_blocks
from quaero.operators.sizing import lookup_join, materialise
from quaero.options import PrefilterOptions

_SEPARATORS = r"[^\p{L}\p{N}]+"
MATCH_SCHEMA = "query_id bigint, value string, score double"


def known_values(values: DataFrame) -> DataFrame:
    """Distinct values with their normal form; of equal normal forms the last value stays."""
    return (
        values.filter(F.col("value") != "")
        .groupBy(tx.normalise(F.col("value")).alias("norm"))
        .agg(F.max("value").alias("value"))
    )


def normal_questions(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", tx.normalise(F.col("text")).alias("norm"))


def _endings(word: Column, sizes: Sequence[int]) -> list[Column]:
    return [
        F.when(F.length(word) >= n, F.concat(F.lit("~"), F.right(word, F.lit(n)))) for n in sizes
    ]


def match_substring(
    questions: DataFrame, values: DataFrame, options: PrefilterOptions = PrefilterOptions()
) -> DataFrame:
    """Values contained in the question whose first occurrence ends at a word boundary.

    Where such a value occurs, its last word ends where a word of the question ends: the whole
    word if the value has several, else the end of a word. So both sides meet on the last word or
    its last (up to three) letters, and only those candidates are searched.
    """
    words = F.filter(F.split("norm", _SEPARATORS), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    ending = F.concat(F.lit("~"), F.right(last, F.least(F.length(last), F.lit(3))))
    value_key = (
        F.when(F.size(words) == 0, "*")
        .when(F.size(words) == 1, ending)
        .otherwise(F.concat(F.lit("="), last))
    )
    known = known_values(values).select(
        "value", F.col("norm").alias("norm_value"), value_key.alias("key")
    )
    whole = F.transform(words, lambda w: F.concat(F.lit("="), w))
    ends = F.flatten(F.transform(words, lambda w: F.array(*_endings(w, (1, 2, 3)))))
    keys = F.filter(
        F.array_distinct(F.concat(whole, ends, F.array(F.lit("*")))), lambda k: k.isNotNull()
    )
    asked = normal_questions(questions).select("query_id", "norm", F.explode(keys).alias("key"))
    at = F.instr(F.col("norm"), F.col("norm_value"))
    following = F.substring(F.col("norm"), at + F.length("norm_value"), F.lit(1))
    return (
        lookup_join(asked, known, ["key"])
        .filter((at > 0) & ~F.regexp_like(following, F.lit(tx.ALNUM)))
        .select(
            "query_id",
            "value",
            (F.lit(options.substring_base) + F.length("norm_value")).cast("double").alias("score"),
        )
    )


def match_token_overlap(questions: DataFrame, values: DataFrame) -> DataFrame:
    """Share of the value's words found in the question; both at least two.

    Only the question side knows roman and arabic twins.
    """
    value_words = tx.significant_tokens(F.col("norm"))
    per_value = (
        known_values(values)
        .select("value", value_words.alias("words"))
        .filter(F.size("words") >= 2)
        .select("value", F.size("words").alias("n_words"), F.explode("words").alias("word"))
        .groupBy("value", "n_words", "word")
        .agg(F.count("*").alias("times"))
    )
    asked_words = tx.expand_numerals(F.array_distinct(tx.significant_tokens(F.col("norm"))))
    asked = normal_questions(questions).select("query_id", F.explode(asked_words).alias("word"))
    return (
        lookup_join(asked, per_value, ["word"])
        .groupBy("query_id", "value", "n_words")
        .agg(F.sum("times").alias("matching"))
        .filter(F.col("matching") >= 2)
        .select(
            "query_id", "value", (F.col("matching") / F.col("n_words")).cast("double").alias("score")
        )
    )


LONGEST_RUN = 6  # characters of a run that values and questions are met on


def run_plan(length: int, wanted: float, slack: int) -> tuple[int, int]:
    """``(size, runs)``: of any so many runs of ``size`` characters of the value one is in the question.

    A window of w characters whose similarity to the value is ``wanted`` or more has M >= wanted *
    (length + w) / 2 characters in matching blocks. Between two blocks at least one character of either
    side is left over, so there are at most 1 + length + w - 2M blocks, and each holds all but size - 1
    of its characters as starts of runs. ``(0, 0)``: no window can be that similar. ``(1, n)``: only
    letters can be told, of any n of the value (counting repeats) one is in the window.
    """
    shortest = max(1, math.ceil(wanted * length / (2 - wanted) - 1e-9)) if wanted < 2 else length + slack + 1
    matched = {w: max(1, math.ceil(wanted * (length + w) / 2 - 1e-9)) for w in range(min(shortest, length), length + slack + 1)}
    matched = {w: m for w, m in matched.items() if m <= min(w, length)}
    if not matched:
        return 0, 0
    for size in range(min(LONGEST_RUN, length), 1, -1):
        kept = min(m - (1 + length + w - 2 * m) * (size - 1) for w, m in matched.items())
        if kept >= 1:
            return size, length - size + 1 - kept + 1
    return 1, length - min(matched.values()) + 1


def letter_tokens(text: str) -> list[str]:
    """Each letter with how often it has stood there, so that sets of tokens count repeats."""
    seen: Counter[str] = Counter()
    out = []
    for c in text:
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return out


def _best_ratio(value: str, text: str, floor: float, slack: int) -> float:
    """Highest similarity of the value to a window; windows that cannot win are ruled out by letter counts."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    starts = np.arange(max(1, len(text) - len(value) + 1))
    width = len(value) + slack
    ends = np.minimum(starts + width, len(codes))
    bounds = np.zeros(len(starts), dtype=np.int64)
    for letter in set(value):
        seen = np.concatenate([[0], np.cumsum(codes == ord(letter))])
        bounds += np.minimum(value.count(letter), seen[ends] - seen[starts])
    bounds = 2.0 * bounds / (len(value) + ends - starts)
    best = 0.0
    for at in np.argsort(-bounds, kind="stable"):
        if bounds[at] < floor or bounds[at] <= best:
            break
        start = int(starts[at])
        best = max(best, SequenceMatcher(None, value, text[start : start + width]).ratio())
    return best


def _damping(words: Sequence[str], asked: Sequence[str], options: PrefilterOptions) -> float:
    known = set(asked)
    few = len(words) >= 2 and sum(w in known for w in words) < 2
    return options.single_overlap_damping if few else 1.0


def _fuzzy_kernel(options: PrefilterOptions):
    """Best fuzzy value per question, for values that no run or letter rules out."""

    def run(frames: Iterator[pd.DataFrame], values: pd.DataFrame) -> Iterator[pd.DataFrame]:
        known = sorted(zip(values["value"], values["norm"], values["words"]), key=lambda v: v[0])
        for frame in frames:
            out = []
            for query_id, text, asked in zip(frame["query_id"], frame["norm"], frame["words"]):
                best, found = 0.0, None
                for value, norm, words in known:
                    factor = _damping(words, asked, options)
                    score = factor * _best_ratio(norm, text, max(options.threshold, best) / factor, options.window_slack)
                    if score > best and score >= options.threshold:
                        best, found = score, value
                if found is not None:
                    out.append((query_id, found, best))
            yield pd.DataFrame(out, columns=["query_id", "value", "score"])

    return run


def _value_runs(known: DataFrame, options: PrefilterOptions) -> DataFrame:
    """``<value, several, size, needed, key>``: runs of the values of two and more words, all letters of the others.

    ``needed``: so many of the value's keys, the rarest, are enough. A value that nothing can be told
    of has the key null; one that no window can be similar enough to has no row.
    """
    several_wanted = options.threshold / options.single_overlap_damping if options.single_overlap_damping else math.inf

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for value, norm, words in zip(frame["value"], frame["norm"], frame["words"]):
                several = len(words) >= 2
                wanted = several_wanted if several else options.threshold
                size, needed = run_plan(len(norm), wanted, options.window_slack) if wanted <= 1 else (0, 0)
                if size > 1 and needed <= len(norm) - size + 1:
                    rows += [(value, size, needed, norm[i : i + size]) for i in range(len(norm) - size + 1)]
                elif size and needed < len(norm):
                    # one letter more than is needed: two of them are there, and both are the key
                    rows += [(value, 1, needed + 1, t) for t in letter_tokens(norm)]
                elif size:
                    rows.append((value, 0, 0, None))
            yield pd.DataFrame(rows, columns=["value", "size", "needed", "key"])

    return known.mapInPandas(emit, "value string, size int, needed int, key string")


def fuzzy_candidates(
    asked: DataFrame, known: DataFrame, options: PrefilterOptions = PrefilterOptions()
) -> tuple[DataFrame, DataFrame]:
    """``(<query_id, value>, <value>)``: all pairs that can be similar enough, and values without an index.

    ``asked<query_id, norm, words>``, ``known<value, norm, words>``. A value of several words two of
    which are in the question meets it on these words. Without them its similarity is damped, so
    it must be all but equal, and long runs of it must be there. Values of one word are met on pairs
    of their rarest letters.
    """
    several = known.filter(F.size("words") >= 2)
    per_word = several.select("value", F.explode("words").alias("word")).groupBy("value", "word").agg(F.count("*").alias("times"))
    words = asked.select("query_id", F.explode("words").alias("word")).distinct()
    by_words = (
        lookup_join(words, per_word, ["word"])
        .groupBy("query_id", "value")
        .agg(F.sum("times").alias("n"))
        .filter("n >= 2")
        .select("query_id", "value")
    )

    keys = materialise(_value_runs(known, options))
    indexed = keys.dropna(subset=["key"])
    counts = indexed.groupBy("key", "size").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("value").orderBy("often", "key")
    chosen = materialise(
        lookup_join(indexed, counts, ["key", "size"])
        .withColumn("place", F.row_number().over(rarest))
        .filter(F.col("place") <= F.col("needed"))
    )
    sizes = sorted(r["size"] for r in chosen.select("size").distinct().collect())  # 1 to LONGEST_RUN

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query_id, norm in zip(frame["query_id"], frame["norm"]):
                for size in sizes:
                    if size > 1:
                        found = {norm[i : i + size] for i in range(len(norm) - size + 1)}
                    else:
                        found = set(letter_tokens(norm))
                    rows += [(query_id, size, key) for key in found]
            yield pd.DataFrame(rows, columns=["query_id", "size", "key"])

    said = asked.select("query_id", "norm").mapInPandas(runs, "query_id long, size int, key string")
    by_runs = lookup_join(said.filter("size > 1"), chosen.filter("size > 1").select("value", "size", "key"), ["size", "key"])

    # letters: only those that are a key of some value; two of them make the key
    letters = chosen.filter("size = 1").select("value", "key")
    useful = lookup_join(said.filter("size = 1").drop("size"), letters.select("key").distinct(), ["key"], "left_semi")
    pairs = []
    for side, name in ((letters, "value"), (useful, "query_id")):
        listed = side.groupBy(name).agg(F.sort_array(F.collect_set("key")).alias("keys"))  # letters of one text
        first = listed.select(name, "keys", F.posexplode("keys").alias("at", "one"))
        both = F.explode(F.slice("keys", F.col("at") + 2, F.greatest(F.size("keys") - F.col("at") - 1, F.lit(0))))
        pairs.append(first.select(name, "one", both.alias("two")))
    by_letters = lookup_join(pairs[1], pairs[0], ["one", "two"])

    columns = ["query_id", "value"]
    found = by_words.unionByName(by_runs.select(columns)).unionByName(by_letters.select(columns)).distinct()
    return found, keys.filter(F.col("key").isNull()).select("value").distinct()


def match_fuzzy_window(
    questions: DataFrame, values: DataFrame, options: PrefilterOptions = PrefilterOptions()
) -> DataFrame:
    """Best value per question by sequence similarity over sliding windows, if above threshold.

    Only the pairs of :func:`fuzzy_candidates` are compared. Values that the threshold leaves without
    an index (a very low one) meet every question, block by block.
    """
    asked = materialise(
        normal_questions(questions).withColumn("words", tx.expand_numerals(tx.significant_tokens(F.col("norm"))))
    )
    known = materialise(
        known_values(values)
        .withColumn("words", tx.significant_tokens(F.col("norm")))
        .filter(F.length("norm") >= options.min_fuzzy_length)
    )
    pairs, others = fuzzy_candidates(asked, known, options)
    named = lookup_join(pairs, known.withColumnsRenamed({"norm": "value_norm", "words": "value_words"}), ["value"])
    paired = lookup_join(named, asked, ["query_id"])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query_id, value, norm, text, words, said in zip(
                *(frame[c] for c in ("query_id", "value", "value_norm", "norm", "value_words", "words"))
            ):
                factor = _damping(words, said, options)
                score = factor * _best_ratio(norm, text, options.threshold / factor, options.window_slack)
                if score >= options.threshold:
                    rows.append((query_id, value, score))
            yield pd.DataFrame(rows, columns=["query_id", "value", "score"])

    columns = ("query_id", "value", "value_norm", "norm", "value_words", "words")
    found = paired.select(*columns).mapInPandas(compare, MATCH_SCHEMA)
    left = others.join(known, "value")
    rest = apply_blocks(asked, left, _fuzzy_kernel(options), MATCH_SCHEMA)
    return best_match(found.unionByName(rest))


def best_match(matches: DataFrame) -> DataFrame:
    """Highest score per question, ties to the first value in order."""
    first = F.min(F.struct((-F.col("score")).alias("low"), F.col("value"))).alias("first")
    return matches.groupBy("query_id").agg(first).select(
        "query_id", "first.value", (-F.col("first.low")).alias("score")
    )


def detect_metadata_value(
    questions: DataFrame,
    values: DataFrame,
    options: PrefilterOptions = PrefilterOptions(),
    fuzzy: bool = True,
) -> DataFrame:
    """``<query_id, matched_value, similarity>`` for questions with an accepted value."""
    exact = match_substring(questions, values, options)
    tiers = exact.unionByName(match_token_overlap(questions, values))
    if fuzzy:
        open_questions = questions.join(exact.select("query_id").distinct(), "query_id", "left_anti")
        tiers = tiers.unionByName(match_fuzzy_window(open_questions, values, options))
    return (
        best_match(tiers)
        .filter(F.col("score") >= options.threshold)
        .select(
            "query_id",
            F.col("value").alias("matched_value"),
            F.round(F.least(F.col("score"), F.lit(1.0)), 6).alias("similarity"),
        )
    )


def detect_boost_value(text: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    """First value of the mapping any of whose keywords is contained in the question."""
    if not mapping:
        return F.lit(None).cast("string")
    norm = tx.normalise(text)
    # one array of tests: the normal form is computed once for all of them
    tests = F.array(
        *[
            tx.contains_any(norm, [tx.normalise_literal(w) for w in words])
            for words in mapping.values()
        ]
    )
    values = F.array(*[F.lit(v) for v in mapping])
    return F.try_element_at(values, F.nullif(F.array_position(tests, True), F.lit(0)).cast("int"))
