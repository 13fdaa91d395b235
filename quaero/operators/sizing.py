"""Join helpers that check sizes before broadcasting and salt what may be skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 * 1024 * 1024
HOT_SHARE = 1e-4
HOT_ROWS = 100_000


def _bytes(field) -> Column:
    """Size of a value: texts and binaries by their bytes, arrays by their elements."""
    kind = field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType):
            return F.coalesce(F.octet_length(F.array_join(field.name, "        ")), F.lit(0))
        return F.coalesce(F.size(field.name) * 8, F.lit(0))
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the frame is small in rows and in bytes; reading stops beyond the row limit."""
    width = sum((_bytes(f) for f in df.schema.fields), F.lit(0)).cast("bigint")
    rows, size = (
        df.limit(max_rows + 1).select(width.alias("w")).agg(F.count("*"), F.sum("w")).first()
    )
    return rows <= max_rows and (size or 0) <= max_bytes


def salted_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Shuffle join that splits the hot keys of ``big``.

    A key is hot from ``hot_rows`` rows on if it also holds more than ``hot_share`` of all rows,
    so there are at most ``1 / hot_share`` hot keys and their list may be broadcast. A hot key
    gets one salt per ``hot_share`` of the rows; only its partners are repeated. All other rows
    join as they are, and no row is lost.
    """
    keys = list(on)
    if how in ("left_semi", "left_anti"):
        other = other.select(*keys).distinct()
    counts = big.groupBy(*keys).agg(F.count("*").alias("_c"))
    total = one_row(counts.agg(F.sum("_c").alias("total")))["total"]
    hot = counts.filter((F.col("_c") >= hot_rows) & (F.col("_c") > total * hot_share)).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.ceil(F.col("_c") / (total * hot_share)).cast("int").alias("_salts"),
    )

    def with_salts(df: DataFrame) -> DataFrame:
        same = [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys]
        joined = df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])
        return joined.withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    salted = with_salts(big).withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.col("_salts")).cast("int"))
    spread = with_salts(other).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    )
    return salted.drop("_salts").join(spread.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    small_fits: bool | None = None,
) -> DataFrame:
    """Join a possibly skewed big side to a narrow side.

    A side that was measured as small is broadcast, so hot keys of the big side stay where they
    are; otherwise the hot keys are split by :func:`salted_join`. ``small_fits`` gives the answer
    where it follows from a size already measured (the hits of counted questions, for one), so
    that nothing is computed twice.
    """
    if small_fits is None:
        small_fits = fits(small, max_rows)
    if small_fits:
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how)


def items_of_hits(items: DataFrame, hits: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
    """Items (each once, maybe wide) with the hits that point to them.

    Few hits are broadcast to the items; many are the side whose hot items are split.
    """
    if few:
        return items.join(F.broadcast(hits), list(on))
    return salted_join(hits, items, on)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key with their rank.

    The filter on ``row_number`` plans as a group limit: each task keeps k rows per key before
    the shuffle, so a hot key never moves whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    out: str,
    block: int = 4096,
    levels: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` by an integer ``position`` that is unique per key.

    Sums inside blocks of ``block`` positions, then over the block totals (and again over their
    blocks with more ``levels``). A window never sees more than one block of rows, or one row per
    block at the top, however big a key is. Without keys the whole frame is one key: three levels.
    """
    keys = list(keys)
    levels = levels if levels is not None else (2 if keys else 3)
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    if levels > 2:
        placed = totals.withColumnRenamed("_block", "_place")
        upto = running_sum(placed, keys, "_place", "_total", "_upto", block, levels - 1)
        offsets = upto.select(
            *keys, F.col("_place").alias("_block"), (F.col("_upto") - F.col("_total")).alias("_offset")
        )
    else:
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
        )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_block", "_inside", "_offset")
    )


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct column (a scalar subquery, so no join)."""
    return df.select(F.struct(*df.columns)).scalar()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder, for results that several branches read.

    Spark removes what it wrote once nothing refers to it, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return (folder or f"{warehouse}/_checkpoints").rstrip("/")
