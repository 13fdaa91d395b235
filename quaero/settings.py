"""Session settings the jobs are written for; pass them to ``SparkSession.builder.config``."""

from __future__ import annotations

CLUSTER_SETTINGS = {
    # runtime re-planning: coalesced shuffles, split skewed partitions, late broadcasts
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # an upper bound that adaptive execution coalesces from
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    # whole texts go to Python in batches: keep a batch of long documents small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}
