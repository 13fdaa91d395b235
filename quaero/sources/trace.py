"""Trace log: one JSON object per question and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = """
query_id string, timestamp string, run_id string, run_iteration int, configuration string, query string,
route struct<source:string,confidence:double,method:string,reasoning:string>,
phases map<string,double>,
crag struct<relevance_ratio:double,rewrite_triggered:boolean,rewrite_ms:double,re_retrieval_ms:double,
  grading_per_chunk_ms:array<double>,relevant_count:int,irrelevant_count:int,ambiguous_count:int,rewritten_query:string>,
sql struct<attempts:array<struct<attempt:int,sql_generation_ms:double,validation_ms:double,execution_ms:double,error_type:string>>,
  total_attempts:int,total_ms:double,success:boolean,query_relaxed:boolean>,
retrieved_docs array<string>, response string, error string
"""


def write_trace_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_trace_log(spark: SparkSession, path: str) -> DataFrame:
    """Events under the fixed schema; blank lines are skipped, broken ones end up apart."""
    schema = TRACE_SCHEMA + ", _broken string"
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )


def retrieved_docs(events: DataFrame) -> DataFrame:
    """One row per retrieved file with its rank."""
    return events.select("query_id", F.posexplode("retrieved_docs").alias("place", "file_name")).select(
        "query_id", (F.col("place") + 1).cast("bigint").alias("rank"), "file_name"
    )
