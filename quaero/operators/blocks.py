"""Apply a function to (rows of a big frame) x (rows of a batch) without a cross join.

A batch that was counted as small is shipped to every task and the big side is scanned once. A
larger batch is cut into blocks, as is the big side; one group holds one block of each, so group
size is bounded whatever the sizes of both sides are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[Iterator[pd.DataFrame], pd.DataFrame], Iterator[pd.DataFrame]]

BATCH_ROWS = 4096
BIG_ROWS = 65_536


def apply_blocks(
    big: DataFrame,
    batch: DataFrame,
    kernel: Kernel,
    schema: str,
    batch_rows: int = BATCH_ROWS,
    big_rows: int = BIG_ROWS,
) -> DataFrame:
    head = batch.limit(batch_rows + 1).toPandas()
    if len(head) <= batch_rows:
        return big.mapInPandas(lambda frames: kernel(frames, head), schema)

    batch_blocks = math.ceil(batch.count() / (batch_rows / 2))
    big_blocks = max(1, math.ceil(big.count() / (big_rows / 2)))

    def placed(df: DataFrame, own: str, blocks: int, other: str, repeats: int) -> DataFrame:
        # whole-row hash: equal blocks even if an id is hot, same place again after a lost task
        return df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
        )

    left = placed(big, "_g", big_blocks, "_b", batch_blocks)
    right = placed(batch, "_b", batch_blocks, "_g", big_blocks)

    def group(rows: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        drop = ["_g", "_b"]
        parts = list(kernel(iter([rows.drop(columns=drop)]), questions.drop(columns=drop)))
        return pd.concat(parts) if parts else pd.DataFrame()

    return (
        left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInPandas(group, schema)
    )
