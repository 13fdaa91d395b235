"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``<node, label>`` of all nodes of ``<a, b>``: the smallest node of each component.

    Every round links each node to its smallest neighbour, follows the links to their ends (in steps
    that double, so a chain of n links takes log n of them), and contracts the edges to these ends.
    Neighbours are summed up map-side; the joins are plain equi joins, whose hot keys adaptive
    execution splits.
    """
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    labels = cut_lineage(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    )
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("up"))
        parents = _ends(cut_lineage(up))
        one = parents.select(F.col("node").alias("label"), F.col("up").alias("_new"))
        labels = cut_lineage(
            labels.join(one, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))
        )
        moved = edges.join(parents.withColumnsRenamed({"node": "a", "up": "_a"}), "a").join(
            parents.withColumnsRenamed({"node": "b", "up": "_b"}), "b"
        )
        edges = cut_lineage(
            moved.where(F.col("_a") != F.col("_b"))
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .distinct()
        )
    return labels


def _ends(up: DataFrame) -> DataFrame:
    """``<node, up>`` with ``up`` replaced by where its links end."""
    while True:
        over = up.select(F.col("node").alias("up"), F.col("up").alias("_top"))
        jumped = up.join(over, "up").select("node", F.col("_top").alias("up"), (F.col("_top") != F.col("up")).alias("_moved"))
        jumped = cut_lineage(jumped)
        up = jumped.select("node", "up")
        if jumped.where("_moved").isEmpty():
            return up
