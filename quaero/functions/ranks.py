"""Nearest-rank percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaero.operators.sizing import fits, lookup_join, materialise

SLICES = 64
TARGET = 100_000  # distinct values that one task orders at most


def nearest_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    percents: Sequence[float],
    slices: int = SLICES,
    target: int = TARGET,
) -> DataFrame:
    """``<by..., pct, value>``: the element at ``min(int(n * pct / 100), n - 1)`` of each group.

    Exact, in bounded memory: equal values are counted first. The distinct values of a group are cut
    into slices along approximate quantiles, and only slices that hold a wanted place go on. While one
    of them has more than ``target`` values it is cut again, so what a task orders in the end has a
    fixed size however large a group is. Slices are for balance only; counts make the result exact.
    """
    keys = list(by)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    few = fits(df.select(*keys).distinct()) if keys else True
    places = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("pct"),
                F.least(F.floor(F.col("_n") * float(p) / 100.0), F.col("_n") - 1).alias("place"),
            )
            for p in percents
        ]
    )
    cuts = [i / slices for i in range(1, slices)]
    rows, level, last = counted.withColumn("_path", F.lit("")), [*keys, "_path"], None
    wanted = None
    while True:
        bounds = rows.groupBy(*level).agg(
            F.percentile_approx("_v", cuts, 10_000).alias("_bounds"), F.sum("_c").alias("_n")
        )
        sliced = lookup_join(rows, bounds, level, small_fits=few).select(
            *keys,
            "_v",
            "_c",
            "_n",
            "_path",
            F.concat_ws(".", "_path", F.lpad(F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).cast("string"), 6, "0")).alias("_slice"),
        )
        # at most ``slices`` rows per group and path from here on
        totals = sliced.groupBy(*level, "_slice").agg(
            F.sum("_c").alias("_t"), F.count("*").alias("_d"), F.first("_n").alias("_n")
        )
        before = Window.partitionBy(*level).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        started = totals.withColumn("_inside", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        if wanted is None:
            started = started.withColumn("_from", F.col("_inside")).withColumn("_asked", places)
        else:  # places count from the start of the group
            asked = wanted.select(*keys, F.col("_slice").alias("_path"), F.col("_from").alias("_base"), F.col("_wanted").alias("_asked"))
            started = lookup_join(started, asked, level, small_fits=few).withColumn("_from", F.col("_base") + F.col("_inside"))
        wanted = materialise(
            started.select(*keys, "_slice", "_from", "_t", "_d", F.explode("_asked").alias("_p"))
            .filter((F.col("_p.place") >= F.col("_from")) & (F.col("_p.place") < F.col("_from") + F.col("_t")))
            .groupBy(*keys, "_slice", "_from", "_d")
            .agg(F.collect_list("_p").alias("_wanted"))
        )
        # as many rows as groups have percentiles
        narrowed = lookup_join(sliced.drop("_n", "_path"), wanted.drop("_d"), [*keys, "_slice"], small_fits=few)
        largest = wanted.agg(F.max("_d")).first()[0] or 0
        if largest <= target or largest == last:
            break
        last = largest
        rows = materialise(narrowed.select(*keys, "_v", "_c", F.col("_slice").alias("_path")))
    slice_order = Window.partitionBy(*keys, "_slice").orderBy("_v")
    running = F.sum("_c").over(slice_order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        narrowed.withColumn("_upto", F.col("_from") + running)
        .select(*keys, "_v", "_c", "_upto", F.explode("_wanted").alias("_p"))
        .filter(
            (F.col("_p.place") < F.col("_upto"))
            & (F.col("_p.place") >= F.col("_upto") - F.col("_c"))
        )
        .select(*keys, F.col("_p.pct").alias("pct"), F.col("_v").alias("value"))
    )


def nearest_rank_wide(
    df: DataFrame, by: Sequence[str], value: str, names: dict[str, float]
) -> DataFrame:
    """One row per group with one column per named percentile."""
    long = nearest_rank(df, by, value, list(names.values()))
    columns = [
        F.max(F.when(F.col("pct") == float(p), F.col("value"))).alias(name)
        for name, p in names.items()
    ]
    return long.groupBy(*by).agg(*columns) if by else long.agg(*columns)
