"""The given tables in the shape of the pipeline model, as DataFrames and as SQL.

pipelines: customer. executions: orders with the totals of their line items. simulations: events per user and type.
metrics and audit_logs: events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.showcase.registry import table

STATUS_OF = {"F": "completed", "O": "running", "P": "pending"}
METRIC_TYPE_OF = {"click": "counter", "view": "counter", "purchase": "gauge", "signup": "histogram", "error": "summary"}
LEVEL_OF = {"click": "DEBUG", "view": "INFO", "purchase": "INFO", "signup": "WARNING", "error": "ERROR"}


def mapped(c: str, words: dict[str, str]) -> Column:
    cases = None
    for word, value in words.items():
        cases = F.when(F.col(c) == word, value) if cases is None else cases.when(F.col(c) == word, value)
    return cases


def mapped_sql(c: str, words: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{w}' THEN '{v}'" for w, v in words.items()) + " END"


def pipelines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def executions(spark: SparkSession, folder: str) -> DataFrame:
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    totals = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.max("l_shipdate").alias("end_time"),
            F.sum("l_quantity").cast("bigint").alias("records_processed"),
            F.sum(returned).cast("bigint").alias("records_failed"),
        )
    )
    started = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("pipeline_id"),
        mapped("o_orderstatus", STATUS_OF).alias("status"),
        F.col("o_orderdate").alias("start_time"),
    )
    return started.join(totals, "id").select(
        "*", F.lit("{}").alias("metrics"), F.lit(None).cast("string").alias("error_message")
    )


EXECUTIONS_SQL = f"""
executions AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS pipeline_id, {mapped_sql('o.o_orderstatus', STATUS_OF)} AS status,
         o.o_orderdate AS start_time, l.end_time, l.records_processed, l.records_failed,
         '{{}}' AS metrics, CAST(NULL AS VARCHAR) AS error_message
  FROM orders o JOIN (
    SELECT l_orderkey, max(l_shipdate) AS end_time, CAST(sum(l_quantity) AS BIGINT) AS records_processed,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS records_failed
    FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""


def simulations(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint")
    grouped = (
        table(spark, folder, "events")
        .groupBy("user_id", "event_type")
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.count(F.lit(1)).alias("attempts_total"),
            F.count_if(F.col("value") > 50).alias("attempts_detected"),
            F.count_if(F.col("value") > 20).alias("attempts_blocked"),
            F.count_if(F.col("value") <= 20).alias("attempts_successful"),
            F.sum(cents).alias("_cents"),
        )
    )
    total = F.col("attempts_total").cast("decimal(20,0)")
    return grouped.select(
        F.concat_ws("|", "user_id", "event_type").alias("id"),
        F.col("event_type").alias("attack_type"),
        "start_time",
        "end_time",
        "attempts_total",
        "attempts_detected",
        "attempts_blocked",
        "attempts_successful",
        F.round(F.col("_cents").cast("decimal(20,0)") / total / 100, 2).cast("decimal(10,2)").alias("mttd_avg_ms"),
        F.round(F.col("attempts_blocked").cast("decimal(20,0)") * 100 / total, 2).cast("decimal(5,2)").alias("security_score"),
    )


def half_up(numerator: str, denominator: str) -> str:
    """Integer quotient rounded half up, for values that are not negative."""
    return f"((2 * ({numerator}) + ({denominator})) // (2 * ({denominator})))"


SIMULATIONS_SQL = f"""
grouped AS (
  SELECT user_id, event_type, min(ts) AS start_time, max(ts) AS end_time, count(*) AS attempts_total,
         count(*) FILTER (WHERE value > 50) AS attempts_detected, count(*) FILTER (WHERE value > 20) AS attempts_blocked,
         count(*) FILTER (WHERE value <= 20) AS attempts_successful,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM events GROUP BY user_id, event_type),
simulations AS (
  SELECT user_id || '|' || event_type AS id, event_type AS attack_type, start_time, end_time, attempts_total,
         attempts_detected, attempts_blocked, attempts_successful,
         {half_up('cents', 'attempts_total')} AS mttd_hundredths,
         {half_up('10000 * attempts_blocked', 'attempts_total')} AS score_hundredths
  FROM grouped)"""


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("metric_name"),
        mapped("event_type", METRIC_TYPE_OF).alias("metric_type"),
        F.col("value"),
        F.col("props").alias("labels"),
        F.col("ts").alias("timestamp"),
    )


def audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        mapped("event_type", LEVEL_OF).alias("level"),
        F.lit("ingestion").alias("module"),
        F.col("event_type").alias("event"),
        F.col("user_id").cast("string").alias("correlation_id"),
        F.col("props").alias("context"),
    )
