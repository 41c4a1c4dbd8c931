"""The summary views and the duration function of the pipeline model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.scalars import duration, failure_rate, mean_2dp, percent, seconds_between


def execution_summary(executions: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Each execution with its pipeline's name, duration and failure rate."""
    names = pipelines.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name"))
    return executions.join(names, "pipeline_id").select(
        "id",
        "pipeline_id",
        "pipeline_name",
        "status",
        "start_time",
        "end_time",
        seconds_between("start_time", "end_time").alias("duration_seconds"),
        "records_processed",
        "records_failed",
        failure_rate("records_failed", "records_processed").alias("failure_rate_percent"),
        "metrics",
        "error_message",
    )


def security_posture(simulations: DataFrame) -> DataFrame:
    """Scores, detection and latency per attack type over the simulations that made attempts."""
    detected = percent("attempts_detected", "attempts_total").cast("decimal(28,12)")
    return (
        simulations.where(F.col("attempts_total") > 0)
        .groupBy("attack_type")
        .agg(
            F.count(F.lit(1)).alias("total_simulations"),
            mean_2dp("security_score").alias("avg_security_score"),
            F.round(F.avg(detected), 2).alias("avg_detection_rate"),
            mean_2dp("mttd_avg_ms").alias("avg_mttd_ms"),
            F.sum("attempts_successful").alias("total_successful_attacks"),
            F.max("start_time").alias("last_simulation_date"),
        )
    )


def execution_duration(executions: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, duration) for each id; null for an unknown or unfinished execution."""
    durations = executions.select("id", duration("start_time", "end_time").alias("duration"))
    return ids.select("id").join(durations, "id", "left")


def register(
    spark: SparkSession, executions: DataFrame, pipelines: DataFrame, simulations: DataFrame, prefix: str = ""
) -> None:
    """The views as temporary views, and ``calculate_execution_duration(id)`` as an SQL function.

    ``prefix`` stands before every name, so that they need not replace views of the session.
    """
    execution_summary(executions, pipelines).createOrReplaceTempView(f"{prefix}execution_summary")
    security_posture(simulations).createOrReplaceTempView(f"{prefix}security_posture")
    executions.createOrReplaceTempView(f"{prefix}executions")
    id_type = executions.schema["id"].dataType.simpleString()
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}calculate_execution_duration(execution_uuid {id_type}) "
        "RETURNS INTERVAL DAY TO SECOND RETURN "
        f"(SELECT max(e.end_time - e.start_time) FROM {prefix}executions e WHERE e.id = execution_uuid)"
    )
