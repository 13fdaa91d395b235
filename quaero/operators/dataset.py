"""Statistics of a labelled question set, and consistent replacement of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quaero.functions import text as tx
from quaero.operators.sizing import lookup_join, one_row


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<attribute, value, n, pct>`` for several attributes in one pass."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns]
        )
    )
    counts = df.select(pairs.alias("p")).groupBy("p.attribute", "p.value").agg(F.count("*").alias("n"))
    total = one_row(df.agg(F.count("*").alias("n")))["n"]
    return counts.withColumn("pct", F.round(100 * F.col("n") / total, 4))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row attribute by the given column values, with row totals."""
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(row).agg(*cells, F.count("*").alias("total"))


def length_stats(df: DataFrame, text: str, partition: str) -> DataFrame:
    """Mean, population deviation, min and max of characters and words, overall and per part."""
    part = F.when(F.grouping(partition) == 1, "overall").otherwise(F.col(partition))
    measured = df.select(
        partition,
        F.length(text).cast("bigint").alias("chars"),
        tx.word_count(F.col(text)).alias("words"),
    )
    aggs = []
    for name in ("chars", "words"):
        aggs += [
            F.round(F.avg(name), 4).alias(f"{name}_mean"),
            F.round(F.stddev_pop(name), 4).alias(f"{name}_std"),
            F.min(name).alias(f"{name}_min"),
            F.max(name).alias(f"{name}_max"),
        ]
    return measured.rollup(partition).agg(part.alias("part"), *aggs).drop(partition)


def vocabulary_overlap(questions: DataFrame, names: DataFrame, min_chars: int = 3) -> DataFrame:
    """Distinct question words of ``min_chars`` or more, and how many occur in corpus names."""
    asked = (
        questions.select(F.explode(F.split(F.lower("text"), tx.TOKEN_BREAK)).alias("word"))
        .filter(F.length("word") >= min_chars)
        .distinct()
    )
    corpus = (
        names.select(F.explode(F.split(F.lower("name"), r"[_\-. ]+")).alias("word"))
        .filter("word <> ''")
        .distinct()
        .withColumn("known", F.lit(1))
    )
    # one row per word on both sides: no key can be hot
    return asked.join(corpus, "word", "left").agg(
        F.count("*").alias("n_words"),
        F.count("known").alias("n_overlap"),
        F.round(tx.ratio(100 * F.count("known"), F.count("*")), 4).alias("pct"),
    )


def behaviours(df: DataFrame, record: str, flags: Sequence[str]) -> DataFrame:
    """Counts per expected route and of true flags in a nested record."""
    return df.filter(F.col(record).isNotNull()).groupBy(F.col(f"{record}.routing").alias("routing")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"{record}.{f}")).alias(f) for f in flags]
    )


DIGITS = 8  # of a code, at least; more when there are more ids than codes of that length


def _clean(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def pseudonym_map(columns: Sequence[tuple[DataFrame, str]], seed: int = 42) -> DataFrame:
    """``<real, fake>``: one code of eight digits or more per id found in any of the columns.

    Ids are ordered by a seeded digest. The first hex digits cut them into 4096 even slices; a
    rank inside its slice plus the sizes of the slices before gives each id its own place, and a
    multiplication coprime to the code space turns places into codes without a collision.
    """
    ids = None
    for frame, column in columns:
        part = frame.select(_clean(F.col(column)).alias("real")).filter("real IS NOT NULL").distinct()
        ids = part if ids is None else ids.unionAll(part)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), "real"), 256)
    keyed = ids.distinct().withColumn("digest", digest).withColumn("slice", F.substring("digest", 1, 3))
    inside = Window.partitionBy("slice").orderBy("digest", "real")
    ranked = keyed.withColumn("r", F.row_number().over(inside))
    # 4096 rows at most
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("slice").agg(F.count("*").alias("n")).select(
        "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = (F.col("offset") + F.col("r") - 1).cast("decimal(20,0)")
    step = 1_000_003 + 2 * 60 * seed  # odd, and never a multiple of 3 or 5: coprime to the space
    first = code_space(ids.distinct().count())
    code = F.lit(first) + F.pmod(place * F.lit(step), F.lit(9 * first))
    return ranked.join(F.broadcast(offsets), "slice").select(
        "real", code.cast("bigint").cast("string").alias("fake")
    )


def code_space(n_ids: int) -> int:
    """The smallest code: a power of ten with at least as many codes of its length as ids."""
    return 10 ** max(DIGITS - 1, len(str(max(0, n_ids - 1) // 9)))


def pseudonymise(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace a column through the mapping; null and blank values stay as they are."""
    keyed = df.withColumn("real", _clean(F.col(column)))
    replaced = lookup_join(keyed, mapping, ["real"], "left")
    return replaced.withColumn(
        column, F.coalesce("fake", F.col(column).cast("string"))
    ).drop("real", "fake")


def pseudonymise_counted(df: DataFrame, column: str, mapping: DataFrame) -> tuple[DataFrame, Observation]:
    """The replaced frame, and what an action over it has seen: ``rows``, ``touched``, ``unknown``.

    Counts come from the pass that writes the frame, whatever that is; ``unknown`` values are neither
    blank nor in the mapping and stay as they are.
    """
    seen = Observation()
    keyed = df.withColumn("real", _clean(F.col(column)))
    replaced = lookup_join(keyed, mapping, ["real"], "left").observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count("fake").alias("touched"),
        F.count_if(F.col("real").isNotNull() & F.col("fake").isNull()).alias("unknown"),
    )
    return replaced.withColumn(column, F.coalesce("fake", F.col(column).cast("string"))).drop("real", "fake"), seen
