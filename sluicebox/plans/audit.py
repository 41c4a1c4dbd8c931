"""Extraction records, audit logs and the removal of secrets."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.scalars import col_of
from sluicebox.plans.model import AUDIT_LOGS

SECRET = "password"
EXTRACTION_MODULE = "ingestion"


def without_secrets(config: Mapping[str, object]) -> dict[str, object]:
    """A configuration without the entries whose name mentions a password."""
    return {k: v for k, v in config.items() if SECRET not in k.lower()}


def map_without_secrets(c: str | Column) -> Column:
    """The same for a map column."""
    return F.map_filter(col_of(c), lambda k, v: ~F.lower(k).contains(SECRET))


def observed(df: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while an action reads it; ``observation.get["records"]`` has the number."""
    observation = Observation(name or f"extraction-{uuid.uuid4().hex}")
    return df.observe(observation, F.count(F.lit(1)).alias("records")), observation


def audit_row(
    spark: SparkSession, level: str, module: str, event: str, context: Mapping[str, object], when: dt.datetime,
    execution_id: str | None = None, correlation_id: str | None = None,
) -> DataFrame:
    """One row in the shape of the audit_logs table; secrets in the context are dropped."""
    document = json.dumps(without_secrets(context), default=str, sort_keys=True)
    row = (str(uuid.uuid4()), execution_id, when, level, module, event, correlation_id, document)
    return spark.createDataFrame([row], AUDIT_LOGS)


def extraction_record(
    spark: SparkSession, source: str, records: int, columns: int | None, success: bool, when: dt.datetime,
    config: Mapping[str, object] | None = None,
) -> DataFrame:
    """The audit row of one extraction; a failed one counts 0 records."""
    event = "extraction_successful" if success else "extraction_failed"
    context = {"connector": source, "records": records if success else 0, "columns": columns, "timestamp": when.isoformat()}
    if config:
        context["config"] = without_secrets(config)
    return audit_row(spark, "INFO" if success else "ERROR", EXTRACTION_MODULE, event, context, when)


def audited_extraction(
    spark: SparkSession, source: str, read: Callable[[], DataFrame], save: Callable[[DataFrame], None],
    record: Callable[[DataFrame], None], when: dt.datetime | None = None, config: Mapping[str, object] | None = None,
) -> int:
    """Read, save, and record the number of rows counted on the way. A failure is recorded and raised again."""
    when = when or dt.datetime.now(dt.timezone.utc)
    try:
        df, observation = observed(read())
        save(df)
        records = observation.get["records"]
    except Exception:
        record(extraction_record(spark, source, 0, None, False, when, config))
        raise
    record(extraction_record(spark, source, records, len(df.columns), True, when, config))
    return records


def write_audit(logs: DataFrame, path: str, page_rows: int = 1000) -> None:
    """Append audit rows, partitioned by day so that time filters skip whole folders.

    The rows of a day are brought together before they are written; a large day is split again by size. Files are sorted by
    correlation id and have bloom filters for the ids, so a lookup of one id passes over files without it by their filter, and reads
    pages of ``page_rows`` rows in the others.
    """
    days = logs.withColumn("log_date", F.to_date("timestamp")).hint("rebalance", "log_date")
    (
        days.sortWithinPartitions("log_date", "correlation_id")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#correlation_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.bloom.filter.enabled#execution_id", "execution_id" in logs.columns)
        .option("parquet.page.row.count.limit", page_rows)
        .partitionBy("log_date")
        .parquet(path)
    )


def find_audit(
    logs: DataFrame, level: str | None = None, module: str | None = None, correlation_id: str | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Audit rows by level, module, correlation id and first day."""
    found = logs
    for column, value in (("level", level), ("module", module), ("correlation_id", correlation_id)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found if since is None else found.where(F.col("log_date") >= since)
