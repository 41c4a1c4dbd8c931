"""The seven tables of the pipeline model: schemas, defaults, rules, foreign keys and first rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.scalars import seconds_between
from sluicebox.operators import rules as R
from sluicebox.operators.sinks import ForeignKey, absent_rows, constants_for_match, with_defaults
from sluicebox.operators.latest import latest
from sluicebox.operators.metrics import run_metrics

# Counters are long: one run may see more rows than an integer holds.
_S, _N, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()
_MS, _SCORE = T.DecimalType(10, 2), T.DecimalType(5, 2)


def _table(required: set[str], **columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, name not in required) for name, dtype in columns.items()])


PIPELINES = _table(
    {"id", "name", "config"},
    id=_S, name=_S, description=_S, config=_S, is_active=_B, created_at=_TS, updated_at=_TS, created_by=_S,
)
EXECUTIONS = _table(
    {"id", "pipeline_id", "status"},
    id=_S, pipeline_id=_S, status=_S, start_time=_TS, end_time=_TS, records_processed=_N, records_failed=_N,
    error_message=_S, metrics=_S,
)
VALIDATION_RESULTS = _table(
    {"id", "execution_id", "rule_name", "rule_type", "passed"},
    id=_S, execution_id=_S, rule_name=_S, rule_type=_S, passed=_B, failed_count=_N, failure_details=_S, timestamp=_TS,
)
AUDIT_LOGS = _table(
    {"id", "level", "module", "event"},
    id=_S, execution_id=_S, timestamp=_TS, level=_S, module=_S, event=_S, correlation_id=_S, context=_S,
)
ATTACK_SCENARIOS = _table(
    {"id", "name", "attack_types", "config"},
    id=_S, name=_S, description=_S, attack_types=T.ArrayType(_S), config=_S, created_by=_S, created_at=_TS,
    updated_at=_TS,
)
SIMULATION_RESULTS = _table(
    {"id", "scenario_id", "attack_type"},
    id=_S, scenario_id=_S, execution_id=_S, attack_type=_S, start_time=_TS, end_time=_TS, attempts_total=_N,
    attempts_detected=_N, attempts_blocked=_N, attempts_successful=_N, mttd_avg_ms=_MS, mttd_p50_ms=_MS,
    mttd_p95_ms=_MS, mttd_p99_ms=_MS, false_positives=_N, vulnerabilities=_S, security_score=_SCORE, report_path=_S,
)
METRICS = _table(
    {"id", "metric_name", "metric_type", "value"},
    id=_S, metric_name=_S, metric_type=_S, value=T.DecimalType(38, 18), labels=_S, timestamp=_TS,
)

TABLES: dict[str, T.StructType] = {
    "pipelines": PIPELINES,
    "executions": EXECUTIONS,
    "validation_results": VALIDATION_RESULTS,
    "audit_logs": AUDIT_LOGS,
    "attack_scenarios": ATTACK_SCENARIOS,
    "simulation_results": SIMULATION_RESULTS,
    "metrics": METRICS,
}

FOREIGN_KEYS = (
    ForeignKey("executions", "pipeline_id", "pipelines"),
    ForeignKey("validation_results", "execution_id", "executions"),
    ForeignKey("audit_logs", "execution_id", "executions", on_delete="set_null"),
    ForeignKey("simulation_results", "scenario_id", "attack_scenarios"),
    ForeignKey("simulation_results", "execution_id", "executions", on_delete="set_null"),
)

# Accepted words. Fixed values.
STATUSES = ("pending", "running", "completed", "failed", "cancelled")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
METRIC_TYPES = ("counter", "gauge", "histogram", "summary")

UNIQUE_COLUMNS = {"pipelines": ["id", "name"], "attack_scenarios": ["id", "name"]}
# Longest texts. Fixed values.
MAX_LENGTHS = {
    "pipelines": {"name": 255, "created_by": 100},
    "executions": {"status": 50},
    "validation_results": {"rule_name": 255, "rule_type": 100},
    "audit_logs": {"level": 20, "module": 100, "event": 255, "correlation_id": 100},
    "attack_scenarios": {"name": 255, "created_by": 100},
    "simulation_results": {"attack_type": 100},
    "metrics": {"metric_name": 255, "metric_type": 50},
}


def _checks(table: str) -> list[R.Rule]:
    counts = ["attempts_total", "attempts_detected", "attempts_blocked", "attempts_successful"]
    return {
        "pipelines": lambda: [R.not_blank("name")],
        "executions": lambda: [R.accepted_values("status", STATUSES), R.ordered("start_time", "end_time")],
        "validation_results": lambda: [R.min_value("failed_count", 0)],
        "audit_logs": lambda: [R.accepted_values("level", LEVELS)],
        "attack_scenarios": lambda: [R.not_blank("name"), R.not_empty("attack_types")],
        "simulation_results": lambda: [
            R.ordered("start_time", "end_time"),
            *[R.min_value(c, 0) for c in counts],
            R.sum_at_most(counts[1:], "attempts_total"),
            R.in_range("security_score", 0, 100),
            *[R.fits_decimal(f"mttd_{m}_ms", 10, 2) for m in ("avg", "p50", "p95", "p99")],
            R.fits_decimal("security_score", 5, 2),
        ],
        "metrics": lambda: [R.accepted_values("metric_type", METRIC_TYPES)],
    }[table]()


def table_rules(table: str, tables: Mapping[str, DataFrame] | None = None) -> list[R.Rule]:
    """All rules of a table; references are included for the parents that ``tables`` holds."""
    required = [R.not_null(f.name) for f in TABLES[table].fields if not f.nullable]
    lengths = [R.max_length(c, n) for c, n in MAX_LENGTHS[table].items()]
    keys = [R.unique(c) for c in UNIQUE_COLUMNS.get(table, ["id"])]
    links = [
        R.references(fk.column, tables[fk.parent], fk.key)
        for fk in FOREIGN_KEYS
        if tables and fk.child == table and fk.parent in tables
    ]
    return [*required, *_checks(table), *lengths, *keys, *links]


def defaults(table: str, now: Column | None = None) -> dict[str, Column]:
    """Values of the columns that an insert leaves out."""
    clock = F.current_timestamp() if now is None else now
    common = {"id": F.uuid()}
    own = {
        "pipelines": {"config": F.lit("{}"), "is_active": F.lit(True), "created_at": clock, "updated_at": clock},
        "executions": {
            "status": F.lit("pending"), "start_time": clock, "records_processed": F.lit(0),
            "records_failed": F.lit(0), "metrics": F.lit("{}"),
        },
        "validation_results": {"failed_count": F.lit(0), "failure_details": F.lit("[]"), "timestamp": clock},
        "audit_logs": {"timestamp": clock, "level": F.lit("INFO"), "context": F.lit("{}")},
        "attack_scenarios": {"config": F.lit("{}"), "created_at": clock, "updated_at": clock},
        "simulation_results": {
            "start_time": clock, "attempts_total": F.lit(0), "attempts_detected": F.lit(0),
            "attempts_blocked": F.lit(0), "attempts_successful": F.lit(0), "false_positives": F.lit(0),
            "vulnerabilities": F.lit("[]"),
        },
        "metrics": {"labels": F.lit("{}"), "timestamp": clock},
    }
    return common | own[table]


def as_table(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """``df`` in the columns and types of a model table, with defaults for absent columns."""
    schema = TABLES[table]
    full = with_defaults(df, schema, defaults(table, now))
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


# First rows of the model. Fixed values.
EXAMPLE_PIPELINE = {
    "name": "example_pipeline",
    "description": "Pipeline de ejemplo para validación inicial",
    "config": '{"source": "postgresql", "validations": ["not_null", "unique"]}',
    "created_by": "system",
}
EXAMPLE_SCENARIOS = (
    {
        "name": "sql_injection_basic",
        "description": "Escenario básico de prueba de inyección SQL",
        "attack_types": ["sql_injection"],
        "config": '{"payloads": ["boolean_based", "union_based"], "frequency": "5/min"}',
        "created_by": "system",
    },
    {
        "name": "data_poisoning_test",
        "description": "Escenario de prueba para contaminación de datos",
        "attack_types": ["data_poisoning"],
        "config": '{"poison_rate": 0.05, "target_fields": ["amount"]}',
        "created_by": "system",
    },
)
EXAMPLE_EXECUTION = {
    "status": "completed",
    "records_processed": 1000,
    "records_failed": 50,
    "metrics": '{"duration_seconds": 45.2, "throughput": 22.2}',
}
EXAMPLE_VALIDATION = {
    "rule_name": "email_not_null",
    "rule_type": "not_null",
    "passed": False,
    "failed_count": 50,
    "failure_details": '[{"row": 10, "column": "email", "value": null}]',
}


def new_pipelines(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """The example pipeline, unless a pipeline of that name exists."""
    rows = spark.createDataFrame([EXAMPLE_PIPELINE], "name string, description string, config string, created_by string")
    return as_table(absent_rows(existing, rows, ["name"]), "pipelines")


def new_scenarios(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """The example scenarios whose name does not exist yet."""
    schema = "name string, description string, attack_types array<string>, config string, created_by string"
    rows = spark.createDataFrame([dict(r) for r in EXAMPLE_SCENARIOS], schema)
    return as_table(absent_rows(existing, rows, ["name"]), "attack_scenarios")


def new_execution(pipelines: DataFrame, name: str = "example_pipeline") -> DataFrame:
    """One example execution of the named pipeline."""
    picked = constants_for_match(pipelines, F.col("name") == name, "id", EXAMPLE_EXECUTION)
    return as_table(picked.withColumnRenamed("id", "pipeline_id"), "executions")


def execution_of(
    df: DataFrame, rules: list[R.Rule], execution_id: str, pipeline_id: str, start: dt.datetime, end: dt.datetime
) -> DataFrame:
    """The executions row of a run that checked ``df``: rows seen, rows that broke a rule, and run metrics."""
    counters = R.run_counters(df, rules)
    times = {"start_time": start, "end_time": end}
    run = counters.select(
        F.lit(execution_id).alias("id"),
        F.lit(pipeline_id).alias("pipeline_id"),
        F.when(F.col("records_failed") > 0, "failed").otherwise("completed").alias("status"),
        *[F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz").alias(c) for c, t in times.items()],
        "records_processed",
        "records_failed",
    )
    seconds = seconds_between("start_time", "end_time")
    return run.withColumn("metrics", run_metrics("records_processed", seconds)).withColumn(
        "error_message", F.lit(None).cast("string")
    )


def new_validation(executions: DataFrame) -> DataFrame:
    """One example validation result of the newest execution."""
    newest = latest(executions, ["start_time"]).select(F.col("id").alias("execution_id"))
    return as_table(newest.select("*", *[F.lit(v).alias(c) for c, v in EXAMPLE_VALIDATION.items()]), "validation_results")


def validate_table(
    table: str, tables: Mapping[str, DataFrame], execution_id: str, run_time: dt.datetime
) -> DataFrame:
    """Results of all rules of one model table."""
    return R.validate(tables[table], table_rules(table, tables), execution_id, run_time)
