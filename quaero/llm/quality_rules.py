"""Documents whose text statistics are outliers of their language and source.

Each document has a vector of transformed statistics. For every language and source the minimum
covariance determinant estimate is sought: the half of the documents whose covariance has the
smallest determinant. Two deterministic starts (all documents; medians and absolute deviations)
are improved by concentration steps: distances to the estimate, then the estimate of the nearer
half. One grouping per step is enough, for it sums counts, values and products by *distance bin*,
and the running totals of the bins give the half and its estimate at once. The better start wins,
is re-estimated from the documents that it accepts, and rejects by Mahalanobis distance.

All of it is built-in functions; Python only writes the plans. Sources with few documents are
estimated together within their language, languages with few documents all together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import WORD_SPACE, cut_lineage, whole_text

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words of a repeated window
MIN_WORDS = 10
REPEAT_PERCENT = 20
FEATURES = ("_x0", "_x1", "_x2", "_x3")
#: What a statistic varies by at least (standard deviations): many are constant in clean text. In a
#: clean group each statistic alone can go beyond REJECT: words 1.6 times as long, 6 % of symbols, 15 %
#: of duplicate lines, 9 % of repeated words (the base rule rejects from 20 % on).
FLOORS = (0.08, 0.35, 0.5, 0.4)
STEP = 1024  # statistics are multiples of 1 / STEP: their sums are exact in any order
MIN_GROUP = 60  # documents of a group that is estimated on its own
STEPS = 4
BINS = 64  # distance bins for each doubling
HALF = 0.5
CONSISTENCY = 2.1  # covariance of the inner half of a normal distribution in four dimensions
ACCEPT = 11.14  # 97.5 % of the chi-squared distribution with four degrees of freedom
REJECT = 31.0  # distances beyond 99.9997 %
BROADCAST_ROWS = 50_000
SALTS = 32

P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``."""
    kept = df.columns
    body = F.col("_body")
    step = df.withColumn("_body", whole_text(text))
    trimmed = F.btrim(body, F.lit(SPACES))
    step = step.withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPACE))
    ).withColumn(
        "_lines", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    )
    n = F.size("_words")
    last = n - (WINDOW - 1)
    step = step.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
        ).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # only texts with a repeated window are sorted
    placed = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    step = step.withColumn("_sorted", placed).drop("_windows")

    def neighbours(array: str, pick):
        m = F.size(array) - 1
        return F.zip_with(F.slice(array, 1, m), F.slice(array, 2, m), pick)

    twins = neighbours("_sorted", lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    repeated = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    step = step.withColumn("_at", F.when(F.col("_sorted").isNotNull(), repeated)).drop("_sorted")
    gaps = neighbours("_at", lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, x: total + x)
    return step.withColumn(
        "n_repeat_words", F.when(F.col("_at").isNotNull(), covered).otherwise(0).cast("long")
    ).drop("_at")


def _features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))

    def percent(part: str, whole: Column) -> Column:
        return F.log1p(100 * F.col(part) / F.greatest(whole, F.lit(1)))

    exact = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        percent("n_symbols", F.col("word_chars")),
        percent("n_dup_lines", F.col("n_lines")),
        percent("n_repeat_words", words),
    )
    return [(F.round(x * STEP) / STEP).alias(name) for x, name in zip(exact, FEATURES)]


def _attach(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Join one row per key to all rows: broadcast after a count, else salted against hot keys."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def _groups(rows: DataFrame) -> DataFrame:
    """``_group`` for each ``_key`` of language and source: its own, its language's, or the common one."""
    counts = rows.groupBy("_key", "_lang").agg(F.count(F.lit(1)).alias("_n"))
    # small sources come together by language, small remainders all together
    small = F.col("_n") < MIN_GROUP
    by_lang = counts.where(small).groupBy("_lang").agg((F.sum("_n") < MIN_GROUP).alias("_few"))
    group = (
        F.when(~small, F.concat(F.lit("s"), F.col("_key")))
        .when(~F.coalesce("_few", F.lit(True)), F.concat(F.lit("l"), F.col("_lang")))
        .otherwise(F.lit("all"))
    )
    return counts.join(by_lang, "_lang", "left").select("_key", group.alias("_group"))


def _sums() -> list[Column]:
    out = [F.count(F.lit(1)).cast("double").alias("_n")]
    out += [F.sum(x).alias(f"_s{i}") for i, x in enumerate(FEATURES)]
    return out + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"_q{i}{j}") for i, j in PAIRS]


def _estimate(sums: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """Mean ``_m*``, Cholesky factor ``_c**`` and log determinant from sums of values and products."""
    out = sums
    for i in range(P):
        out = out.withColumn(f"_m{i}", F.col(f"_s{i}") / F.col("_n"))
    for i, j in PAIRS:
        cov = (F.col(f"_q{i}{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}")) * factor
        out = out.withColumn(f"_v{i}{j}", cov + FLOORS[i] ** 2 if i == j else cov)
    return _cholesky(out, keys)


def _cholesky(out: DataFrame, keys: list[str]) -> DataFrame:
    for i, j in PAIRS:
        rest = reduce(lambda a, k: a - F.col(f"_c{i}{k}") * F.col(f"_c{j}{k}"), range(j), F.col(f"_v{i}{j}"))
        value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"_c{j}{j}")
        out = out.withColumn(f"_c{i}{j}", value)
    det = reduce(lambda a, i: a + 2 * F.log(F.col(f"_c{i}{i}")), range(P), F.lit(0.0))
    columns = [f"_m{i}" for i in range(P)] + [f"_c{i}{j}" for i, j in PAIRS]
    return out.select(*keys, *columns, det.alias("_det"))


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with ``_d``: the squared Mahalanobis distance to their estimate (forward substitution)."""
    out, kept = rows, [c for c in rows.columns]
    packed = F.struct(*[c for c in estimates.columns if c != "_group"])
    starts = estimates.groupBy("_group").agg(F.collect_list(packed).alias("_starts"))  # at most two
    out = _attach(out, starts, "_group").withColumn("_e", F.explode("_starts")).drop("_starts")
    for i in range(P):
        rest = F.col(FEATURES[i]) - F.col(f"_e._m{i}")
        rest = reduce(lambda a, k: a - F.col(f"_e._c{i}{k}") * F.col(f"_y{k}"), range(i), rest)
        out = out.withColumn(f"_y{i}", rest / F.col(f"_e._c{i}{i}"))
    d = reduce(lambda a, i: a + F.col(f"_y{i}") * F.col(f"_y{i}"), range(P), F.lit(0.0))
    start = [F.col("_e._start")] if "_start" in estimates.columns else []
    return out.select(*kept, *start, d.alias("_d"))


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: the estimates of the nearer half of every group."""
    near = _with_distance(rows, estimates)
    bins = near.withColumn("_bin", F.floor(BINS * F.log2(1 + F.col("_d"))).cast("int"))
    sums = bins.groupBy("_group", "_start", "_bin").agg(*_sums())
    run = Window.partitionBy("_group", "_start").orderBy("_bin")
    names = ["_n", *[f"_s{i}" for i in range(P)], *[f"_q{i}{j}" for i, j in PAIRS]]
    everything = Window.partitionBy("_group", "_start")
    running = sums.select(
        "_group", "_start", "_bin",
        F.sum("_n").over(everything).alias("_total"),
        *[F.sum(c).over(run.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in names],
    )
    enough = running.where(F.col("_n") >= F.ceil(F.col("_total") * HALF))
    first = enough.withColumn("_k", F.row_number().over(run)).where(F.col("_k") == 1)
    return _estimate(first, 1.0, ["_group", "_start"])


def covariance_estimates(rows: DataFrame) -> DataFrame:
    """``<_group, mean, Cholesky factor>``: reweighted minimum covariance determinant estimates."""
    whole = _estimate(rows.groupBy("_group").agg(*_sums()), 1.0, ["_group"])
    # exact medians: statistics take few distinct values, which is what is counted
    middle = rows.groupBy("_group").agg(*[F.percentile(x, F.lit(0.5)).alias(f"_m{i}") for i, x in enumerate(FEATURES)])
    middle = cut_lineage(middle)
    off = _attach(rows, middle, "_group").groupBy("_group").agg(
        *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(P)],
        *[F.percentile(F.abs(F.col(x) - F.col(f"_m{i}")), F.lit(0.5)).alias(f"_a{i}") for i, x in enumerate(FEATURES)],
    )
    for i, j in PAIRS:
        scale = F.pow(1.4826 * F.col(f"_a{i}"), 2) + FLOORS[i] ** 2
        off = off.withColumn(f"_v{i}{j}", scale if i == j else F.lit(0.0))
    robust = _cholesky(off, ["_group"])
    starts = whole.withColumn("_start", F.lit(0)).unionByName(robust.withColumn("_start", F.lit(1)))
    estimates = cut_lineage(starts)
    for _ in range(STEPS):
        estimates = cut_lineage(_concentrated(rows, estimates))
    order = Window.partitionBy("_group").orderBy("_det", "_start")
    best = estimates.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 1).drop("_k", "_start")
    # the half is too tight for all: widen it, then estimate from all that it accepts
    accepted = _with_distance(rows, best).where(F.col("_d") <= ACCEPT * CONSISTENCY)
    return cut_lineage(_estimate(accepted.groupBy("_group").agg(*_sums()), 1.0, ["_group"]))


def quality_verdicts(
    df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``<id, base statistics, base_failed, kept, distance>`` of every row.

    A null or empty text has no words and fails. Null languages and sources are groups of their own.
    A group of fewer than ``MIN_GROUP`` rows in all rejects nothing. ``distance`` is null where
    ``base_failed``. Repeated rows stay and count as often as they occur; other columns aren't read.
    """

    def named(column: str, mark: str) -> Column:
        return F.coalesce(F.concat(F.lit(mark), F.col(column).cast("string")), F.lit(""))

    rows = df.select(
        F.col(id).alias("_id"), F.col(text).alias("_text"), named(lang, "=").alias("_lang"), named(source, "=").alias("_source")
    )
    stats = base_statistics(rows, "_text").drop("_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    key = F.to_json(F.struct("_lang", "_source"))
    stats = cut_lineage(stats.select("*", *_features(), key.alias("_key")))
    candidates = stats.where(~F.col("base_failed"))
    groups = cut_lineage(_groups(candidates))
    vectors = cut_lineage(_attach(candidates.select("_key", *FEATURES), groups, "_key").select("_group", *FEATURES))
    sizes = vectors.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_GROUP)
    estimates = covariance_estimates(_attach(vectors, cut_lineage(sizes), "_group").drop("_n"))
    placed = groups.join(estimates.select("_group"), "_group")
    judged = _with_distance(_attach(candidates, placed, "_key"), estimates)
    few = _attach(candidates, groups.join(estimates, "_group", "left_anti"), "_key").withColumn("_d", F.lit(None).cast("double"))
    rest = stats.where("base_failed").withColumn("_d", F.lit(None).cast("double"))
    columns = ["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_d"]
    every = judged.select(columns).unionByName(few.select(columns)).unionByName(rest.select(columns))
    kept = ~F.col("base_failed") & (F.coalesce("_d", F.lit(0.0)) <= REJECT)
    return every.select(
        F.col("_id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), F.col("_d").alias("distance"),
    )
