"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``VIRTUAL_NODES`` points of a ring; a row belongs to the arc its key hashes to and
asks the shards clockwise from there. A shard that is full passes rows on, so loads are guaranteed:
its capacity is the floor or the ceiling of rows / shards (law ``rows``).

Which rows overflow depends on how many rows each arc has, and nothing else: the ring has a fixed
number of arcs, so their counts (a few hundred numbers) are all the driver sees. It hands
out stretches of each arc; a row finds its own by its rank in the arc. Ranks come from counts of
fine hash buckets and a row number inside a bucket: no task sees more than a bucket.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import cut_lineage, whole_text

VIRTUAL_NODES = 64  # points of each shard on the ring
RING = 1 << 32
BUCKET_ROWS = 20_000  # rows of a fine bucket, on average
FEWEST_BUCKETS = 4  # buckets of an arc at least


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """``(point, shard)`` clockwise; a shard's points don't depend on the number of shards."""

    def point(shard: int, node: int) -> int:
        digest = hashlib.sha256(f"{shard}:{node}".encode()).digest()
        return int.from_bytes(digest[:4], "big")

    return sorted((point(s, v), s) for s in range(n_shards) for v in range(virtual_nodes))


def preferences(points: list[tuple[int, int]], n_shards: int) -> list[list[int]]:
    """For each arc, the shards in the order they are met clockwise."""
    orders = []
    for k in range(len(points)):
        met = dict.fromkeys(points[(k + j) % len(points)][1] for j in range(len(points)))
        orders.append(list(met)[:n_shards])
    return orders


def stretches(counts: list[int], orders: list[list[int]], n_shards: int) -> list[list[tuple]]:
    """Hand out the rows of each arc: ``(from rank, shard, first slot)``.

    All arcs ask their first shard, then what is left asks the next one clockwise, and so on.
    """
    total = sum(counts)
    free = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    slots, given = [0] * n_shards, [0] * len(counts)
    parts: list[list[tuple]] = [[] for _ in counts]
    for j in range(n_shards):
        for arc, n in enumerate(counts):
            shard = orders[arc][j]
            take = min(n - given[arc], free[shard])
            if take:
                parts[arc].append((given[arc], shard, slots[shard]))
                given[arc] += take
                free[shard] -= take
                slots[shard] += take
    return parts


def _arc(point: Column, points: list[tuple[int, int]]) -> Column:
    """The arc of a ring point: the first node at or after it; past the last node it is arc 0."""
    starts = [p for p, _ in points]
    # a table of the ring's 4,096 equal sectors narrows the search to the nodes inside one sector
    sectors = 4_096
    width = RING // sectors
    first = F.array(*[F.lit(bisect_right(starts, s * width - 1)) for s in range(sectors)])
    inside = max(
        bisect_right(starts, (s + 1) * width - 1) - bisect_right(starts, s * width - 1)
        for s in range(sectors)
    )
    nodes = F.array(*[F.lit(p).cast("long") for p in [*starts, *[RING] * (inside + 1)]])
    low = F.element_at(first, F.shiftright(point, 20).cast("int") + 1)
    arc = low
    for j in range(inside):
        arc = arc + (F.element_at(nodes, low + j + 1) < point).cast("int")
    return F.pmod(arc, F.lit(len(points)))


def shard_rows(
    df: DataFrame, n_shards: int = 8, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``<id, size, text_crc32, shard, slot>`` of every row; shards hold equal counts, give or take 1.

    ``size`` is the UTF-8 bytes of the text plus 1; a null text has none, and the checksum of the
    empty text. A null id is a key of its own (the ring point of the empty string). Rows that are
    equal in id and text are interchangeable: they take neighbouring places in any order. Fewer
    rows than shards leave shards empty. Other columns are not read.
    """
    points = ring(n_shards)
    orders = preferences(points, n_shards)
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    body = whole_text(text)
    rows = df.select(
        F.col(id).alias("_id"),
        (F.octet_length(body).cast("long") + 1).alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
        F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long").alias("_point"),
    )
    rows = rows.withColumn("_arc", _arc(F.col("_point"), points))
    n_rows = df.count()
    per_arc = max(FEWEST_BUCKETS, -(-n_rows // (BUCKET_ROWS * len(points))))
    # the hash of the whole row: a key that many rows share spreads over the arc's buckets
    bucket = F.pmod(F.xxhash64("_id", "_crc", "_size"), F.lit(per_arc)).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    sizes = cut_lineage(rows.groupBy("_arc", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("_arc").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_arc", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    counts = [0] * len(points)  # one number for each arc of the ring
    for r in sizes.groupBy("_arc").agg(F.sum("_n").alias("n")).collect():
        counts[r["_arc"]] = r["n"]
    parts = stretches(counts, orders, n_shards)
    plan = df.sparkSession.createDataFrame(
        [(arc, [p[0] for p in ps], [p[1] for p in ps], [p[2] for p in ps]) for arc, ps in enumerate(parts)],
        "_arc int, _from array<long>, _shards array<int>, _slots array<long>",
    )
    inside = Window.partitionBy("_arc", "_bucket").orderBy("_point", "_id", "_crc", "_size")
    ranked = (
        rows.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, ["_arc", "_bucket"])
        .join(F.broadcast(plan), "_arc")  # at most n_shards * VIRTUAL_NODES rows
        .withColumn("_rank", F.col("_row") + F.col("_before"))
        .withColumn("_part", F.size(F.filter("_from", lambda f: f <= F.col("_rank"))))
    )
    return ranked.select(
        F.col("_id").alias(id),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.element_at("_shards", F.col("_part")).alias("shard"),
        (
            F.element_at("_slots", F.col("_part"))
            + F.col("_rank")
            - F.element_at("_from", F.col("_part"))
        ).alias("slot"),
    )
