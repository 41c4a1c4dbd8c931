"""Views, rollups, metric and audit tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.scalars import (
    array_length, json_contains, json_value, money_round, null_or, seconds_between, sum_of, trimmed_length,
)
from sluicebox.operators.corrupt import numeric_columns
from sluicebox.operators.label_index import find_labelled, label_counts, write_indexed
from sluicebox.operators.latest import latest
from sluicebox.operators.metrics import (
    LATENCY_POINTS, latency_rollup, latest_metrics, rank_errors, sketch_rank_error, sketched_latency, throughput,
    write_latency_sketches, write_metrics,
)
from sluicebox.operators.profile import distinct_error, distinct_sketched, heavy_labels, labels, null_cells, profile
from sluicebox.plans import audit, maintained, model, views
from sluicebox.operators.rules import failed_counts
from sluicebox.operators.sinks import constants_for_match
from sluicebox import scratch
from sluicebox.scratch import scratch_path
from sluicebox.showcase import relations as rel
from sluicebox.showcase.registry import SQL, query, table
from sluicebox.sources.jdbc import bound_query, with_parameters


@query(
    "vw_execution_summary",
    f"""WITH {rel.EXECUTIONS_SQL}
    SELECT e.id, e.pipeline_id, p.c_name AS pipeline_name, e.status, e.start_time, e.end_time,
           (epoch_us(e.end_time) - epoch_us(e.start_time)) / 1000000.0::DOUBLE AS duration_seconds,
           e.records_processed, e.records_failed,
           CASE WHEN e.records_processed > 0
                THEN {rel.half_up('10000 * e.records_failed', 'e.records_processed')} / 100.0::DOUBLE
                ELSE 0.0::DOUBLE END AS failure_rate_percent,
           e.metrics, e.error_message
    FROM executions e JOIN customer p ON p.c_custkey = e.pipeline_id""",
)
def vw_execution_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = views.execution_summary(rel.executions(spark, folder), rel.pipelines(spark, folder))
    return summary.withColumn("failure_rate_percent", F.col("failure_rate_percent").cast("double"))


@query(
    "vw_security_posture",
    f"""WITH {rel.SIMULATIONS_SQL}
    SELECT attack_type, count(*) AS total_simulations,
           {rel.half_up('CAST(sum(score_hundredths) AS BIGINT)', 'count(*)')} / 100.0::DOUBLE AS avg_security_score,
           round(avg(attempts_detected * 100.0::DOUBLE / attempts_total), 2) AS avg_detection_rate,
           {rel.half_up('CAST(sum(mttd_hundredths) AS BIGINT)', 'count(*)')} / 100.0::DOUBLE AS avg_mttd_ms,
           CAST(sum(attempts_successful) AS BIGINT) AS total_successful_attacks,
           max(start_time) AS last_simulation_date
    FROM simulations WHERE attempts_total > 0 GROUP BY attack_type""",
)
def vw_security_posture(spark: SparkSession, folder: str) -> DataFrame:
    posture = views.security_posture(rel.simulations(spark, folder))
    doubles = ["avg_security_score", "avg_detection_rate", "avg_mttd_ms"]
    return posture.select(*[F.col(c).cast("double").alias(c) if c in doubles else F.col(c) for c in posture.columns])


@query("posture_incremental", SQL["vw_security_posture"])
def posture_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The posture after inserts, updates and deletes, from the state before them.

    Before the change, every fifth user's simulations were missing, every third user's had other results, and every seventh
    user's were there a second time and a day later, so that the latest start of each type is taken away.
    """
    after = scratch.written(rel.simulations(spark, folder), "simulations")
    user = F.split("id", r"\|")[0].cast("bigint")
    inserted, updated, doubled = user % 5 == 0, (user % 3 == 0) & (user % 5 != 0), user % 7 == 0
    older = after.where(updated).withColumns({
        "attempts_successful": F.col("attempts_successful") + 5, "security_score": F.lit(1).cast("decimal(5,2)"),
        "start_time": F.col("start_time") - F.expr("INTERVAL 1 HOUR"),
    })
    surplus = after.where(doubled).withColumn("start_time", F.col("start_time") + F.expr("INTERVAL 1 DAY"))
    before = after.where(~inserted & ~updated).unionByName(older).unionByName(surplus)
    removed = older.unionByName(surplus)
    added = after.where(inserted).unionByName(after.where(updated))
    state = scratch.written(maintained.posture_state(before), "posture")
    posture = maintained.posture_of(maintained.changed_posture(state, removed, added, after))
    doubles = ["avg_security_score", "avg_detection_rate", "avg_mttd_ms"]
    return posture.select(*[F.col(c).cast("double").alias(c) if c in doubles else F.col(c) for c in posture.columns])


@query(
    "execution_duration",
    f"""WITH {rel.EXECUTIONS_SQL}
    SELECT o.o_orderkey AS id, epoch_us(e.end_time) - epoch_us(e.start_time) AS duration_us
    FROM orders o LEFT JOIN executions e ON e.id = o.o_orderkey""",
)
def execution_duration(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    found = views.execution_duration(rel.executions(spark, folder), ids)
    seconds = F.extract(F.lit("SECOND"), "duration") + F.extract(F.lit("MINUTE"), "duration") * 60
    whole = F.extract(F.lit("HOUR"), "duration") * 3600 + F.extract(F.lit("DAY"), "duration") * 86400
    return found.select("id", ((seconds + whole) * 1_000_000).cast("bigint").alias("duration_us"))


@query(
    "duration_function",
    f"""WITH {rel.EXECUTIONS_SQL}
    SELECT o.o_orderkey AS id, epoch_us(e.end_time) - epoch_us(e.start_time) > 0 AS took_time
    FROM orders o LEFT JOIN executions e ON e.id = o.o_orderkey""",
)
def duration_function(spark: SparkSession, folder: str) -> DataFrame:
    views.register(spark, rel.executions(spark, folder), rel.pipelines(spark, folder), rel.simulations(spark, folder), "checked_")
    table(spark, folder, "orders").createOrReplaceTempView("duration_orders")
    return spark.sql(
        "SELECT o_orderkey AS id, checked_calculate_execution_duration(o_orderkey) > INTERVAL '0' SECOND AS took_time "
        "FROM duration_orders"
    )


# Rows that break each rule of the executions.
LONG_STATUS = "lost" * 13


@query(
    "execution_results",
    f"""WITH {rel.EXECUTIONS_SQL},
    spoiled AS (
      SELECT CASE WHEN id % 103 = 0 THEN NULL ELSE id END AS id,
             CASE WHEN id % 89 = 0 THEN NULL WHEN id % 83 = 0 THEN -1 ELSE pipeline_id END AS pipeline_id,
             CASE WHEN id % 97 = 0 THEN '{LONG_STATUS}' WHEN id % 79 = 0 THEN 'lost' WHEN id % 73 = 0 THEN NULL ELSE status END AS status,
             start_time, end_time
      FROM (SELECT * FROM executions UNION ALL SELECT * FROM executions WHERE id % 101 = 0)),
    executions_of_ids AS (SELECT id, count(*) AS n FROM spoiled WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
    SELECT 'status_accepted' AS rule_name, count(*) FILTER (WHERE status NOT IN
             ('pending', 'running', 'completed', 'failed', 'cancelled')) AS failed_count FROM spoiled
    UNION ALL SELECT 'end_time_after_start_time', count(*) FILTER (WHERE end_time < start_time) FROM spoiled
    UNION ALL SELECT 'id_not_null', count(*) FILTER (WHERE id IS NULL) FROM spoiled
    UNION ALL SELECT 'pipeline_id_not_null', count(*) FILTER (WHERE pipeline_id IS NULL) FROM spoiled
    UNION ALL SELECT 'status_not_null', count(*) FILTER (WHERE status IS NULL) FROM spoiled
    UNION ALL SELECT 'status_max_length', count(*) FILTER (WHERE length(status) > 50) FROM spoiled
    UNION ALL SELECT 'id_unique', coalesce(sum(n), 0)::BIGINT FROM executions_of_ids
    UNION ALL SELECT 'pipeline_id_references', count(*) FROM spoiled e
      WHERE pipeline_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.pipeline_id)""",
)
def execution_results(spark: SparkSession, folder: str) -> DataFrame:
    def every(n: int) -> Column:
        return F.col("id") % n == 0

    runs = rel.executions(spark, folder)
    spoiled = runs.unionByName(runs.where(every(101))).withColumns({
        "id": F.when(~every(103), F.col("id")),
        "pipeline_id": F.when(every(89), None).when(every(83), -1).otherwise(F.col("pipeline_id")),
        "status": F.when(every(97), LONG_STATUS).when(every(79), "lost").when(every(73), None).otherwise(F.col("status")),
    })
    tables = {"executions": spoiled, "pipelines": rel.pipelines(spark, folder)}
    results = model.validate_table("executions", tables, "run-1", dt.datetime(2025, 1, 1))
    return results.select("rule_name", F.col("failed_count").cast("bigint").alias("failed_count"))


@query(
    "simulation_results",
    f"""WITH {rel.SIMULATIONS_SQL}
    SELECT 'attempts_total_bounds_parts' AS rule_name,
           count(*) FILTER (WHERE attempts_detected + attempts_blocked + attempts_successful > attempts_total) AS failed_count
      FROM simulations
    UNION ALL SELECT 'security_score_range',
           count(*) FILTER (WHERE score_hundredths NOT BETWEEN 0 AND 10000) FROM simulations
    UNION ALL SELECT 'end_time_after_start_time', count(*) FILTER (WHERE end_time < start_time) FROM simulations""",
)
def simulation_results(spark: SparkSession, folder: str) -> DataFrame:
    names = ["attempts_total_bounds_parts", "security_score_range", "end_time_after_start_time"]
    rules = [r for r in model.table_rules("simulation_results") if r.name in names]
    return failed_counts(rel.simulations(spark, folder), rules).select("rule_name", "failed_count")


@query(
    "latency_rollup",
    """SELECT event_type, count(*) AS samples, round(avg(value), 6) AS mean,
              round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
              round(quantile_cont(value, 0.99), 6) AS p99
       FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def latency_of_events(spark: SparkSession, folder: str) -> DataFrame:
    rollup = latency_rollup(table(spark, folder, "events"), "event_type", "value")
    return rollup.select("event_type", "samples", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query(
    "latency_by_user",
    """SELECT user_id, count(*) AS samples, round(avg(value), 6) AS mean,
              round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
              round(quantile_cont(value, 0.99), 6) AS p99
       FROM events WHERE value IS NOT NULL GROUP BY user_id""",
)
def latency_by_user(spark: SparkSession, folder: str) -> DataFrame:
    rollup = latency_rollup(table(spark, folder, "events"), "user_id", "value")
    return rollup.select("user_id", "samples", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query(
    "latency_sketched",
    """SELECT event_type, count(*) AS samples, round(avg(value), 6) AS mean, min(value) AS minimum, max(value) AS maximum,
              TRUE AS p50_within, TRUE AS p95_within, TRUE AS p99_within
       FROM events WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-03' GROUP BY event_type""",
)
def latency_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of days rolled up by type; the ranks are measured against all samples.

    Three times the error of 99 cases in 100 is some eight standard deviations.
    """
    path, since = scratch_path(spark, "sketches"), dt.date(2024, 1, 3)
    events = table(spark, folder, "events")
    write_latency_sketches(events, path, ["event_type"], "value", "ts")
    rolled = sketched_latency(spark.read.parquet(path).where(F.col("sketch_date") >= since), ["event_type"])
    errors = rank_errors(events.where(F.col("ts") >= F.lit(since)), "event_type", "value", rolled)
    within = [(F.col(c) <= 3 * sketch_rank_error()).alias(f"{c}_within") for c in LATENCY_POINTS]
    exact = rolled.select("event_type", "samples", F.round("mean", 6).alias("mean"), "minimum", "maximum")
    return exact.join(errors.select("event_type", *within), "event_type")


@query(
    "metric_latest",
    """SELECT event_id AS id, event_type AS metric_name, value, props AS labels, ts AS timestamp FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def metric_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_metrics(rel.metrics(spark, folder)).select("id", "metric_name", "value", "labels", "timestamp")


@query(
    "metric_store",
    f"""SELECT event_type AS metric_name, {rel.mapped_sql('event_type', rel.METRIC_TYPE_OF)} AS metric_type,
               CAST(ts AS DATE) AS metric_date, count(*) AS samples, max(value) AS maximum
        FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY ALL""",
)
def metric_store(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    write_metrics(rel.metrics(spark, folder), path)
    stored = spark.read.parquet(path).where(F.col("metric_date") >= dt.date(2024, 1, 3))
    return stored.groupBy("metric_name", "metric_type", "metric_date").agg(
        F.count(F.lit(1)).alias("samples"), F.max("value").alias("maximum")
    )


@query(
    "json_label_filter",
    """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
       WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 42""",
)
def json_label_filter(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(json_contains("props", "$.k", 42, "bigint"))
    return events.select("event_id", "event_type", json_value("props", "$.k", "bigint").alias("k"))


@query("json_label_indexed", SQL["json_label_filter"])
def json_label_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same search by an index kept beside the stored rows: only parts that hold the label are read."""
    path = scratch_path(spark, "labelled")
    write_indexed(table(spark, folder, "events"), path, "props", "all")
    found = find_labelled(spark, path, "props", {"k": 42})
    return found.select("event_id", "event_type", json_value("props", "$.k", "bigint").alias("k"))


@query(
    "json_label_counts",
    """SELECT 'k' AS path, json_extract_string(props, '$.k') AS value, count(*) AS records FROM events
       WHERE json_extract_string(props, '$.k') = '7' GROUP BY ALL""",
)
def json_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold a label, counted from the index of two stored batches; no stored row is read."""
    path, events = scratch_path(spark, "labelled"), table(spark, folder, "events")
    errors = F.coalesce(F.col("event_type") == "error", F.lit(False))
    write_indexed(events.where(errors), path, "props", "errors", parts=16)
    write_indexed(events.where(~errors), path, "props", "others")
    return label_counts(spark, path, {"k": 7, "missing": 7})


@query(
    "run_throughput",
    f"""WITH {rel.EXECUTIONS_SQL}
    SELECT id, round(records_processed / nullif((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0::DOUBLE, 0), 9)
           AS throughput
    FROM executions""",
)
def run_throughput(spark: SparkSession, folder: str) -> DataFrame:
    seconds = seconds_between("start_time", "end_time")
    rate = throughput("records_processed", seconds)
    return rel.executions(spark, folder).select("id", F.round(rate, 9).alias("throughput"))


@query(
    "audit_by_level",
    f"""SELECT {rel.mapped_sql('event_type', rel.LEVEL_OF)} AS level, event_type AS event, count(*) AS entries
        FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03' GROUP BY ALL""",
)
def audit_by_level(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "audit")
    audit.write_audit(rel.audit_logs(spark, folder), path)
    found = audit.find_audit(
        spark.read.parquet(path), level="ERROR", module="ingestion", since=F.lit(dt.date(2024, 1, 3))
    )
    return found.groupBy("level", "event").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "audit_by_correlation",
    """SELECT event_id AS id, ts AS timestamp, event_type AS event, CAST(user_id AS VARCHAR) AS correlation_id
       FROM events WHERE user_id = 7""",
)
def audit_by_correlation(spark: SparkSession, folder: str) -> DataFrame:
    found = audit.find_audit(rel.audit_logs(spark, folder), correlation_id="7")
    return found.select("id", "timestamp", "event", "correlation_id")


@query(
    "audit_lookup",
    """SELECT event_id AS id, ts AS timestamp, event_type AS event, CAST(user_id AS VARCHAR) AS correlation_id, props AS context
       FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-02'""",
)
def audit_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Stored logs by correlation id and day: filters and page bounds of the files pass over nearly all other rows."""
    path = scratch_path(spark, "audit")
    audit.write_audit(rel.audit_logs(spark, folder), path)
    found = audit.find_audit(spark.read.parquet(path), correlation_id="7", since=F.lit(dt.date(2024, 1, 2)))
    return found.select("id", "timestamp", "event", "correlation_id", "context")


@query(
    "audit_counts",
    """SELECT 'INFO' AS level, 'extraction_successful' AS event, count(*) AS records,
              CAST(6 AS BIGINT) AS columns FROM orders""",
)
def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    path, logs = scratch_path(spark, "extracted"), scratch_path(spark, "audit")
    audit.audited_extraction(
        spark, "parquet", lambda: table(spark, folder, "orders"), lambda df: df.write.parquet(path),
        lambda row: audit.write_audit(row, logs), config={"path": folder, "db_password": "hidden"},
    )
    recorded = spark.read.parquet(logs)
    return recorded.select(
        "level",
        "event",
        json_value("context", "$.records", "bigint").alias("records"),
        json_value("context", "$.columns", "bigint").alias("columns"),
    )


@query(
    "audit_redacted",
    """SELECT c_custkey, list_sort(['host', 'user']) AS kept, 'db' || CAST(c_nationkey AS VARCHAR) AS host FROM customer""",
)
def audit_redacted(spark: SparkSession, folder: str) -> DataFrame:
    config = F.create_map(
        F.lit("host"), F.concat(F.lit("db"), F.col("c_nationkey").cast("string")), F.lit("user"), F.col("c_name"),
        F.lit("PassWord"), F.col("c_mktsegment"), F.lit("old_password_hint"), F.col("c_mktsegment"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", audit.map_without_secrets(config).alias("config"))
    return customers.select(
        "c_custkey", F.array_sort(F.map_keys("config")).alias("kept"), F.col("config")["host"].alias("host")
    )


@query(
    "profile_nulls",
    """WITH j AS (SELECT coalesce(v.vec_id, l.doc_id) AS id, v.label, l.quality, l.toxic
                  FROM embeddings v FULL JOIN labels l ON v.vec_id = l.doc_id)
       SELECT 'id' AS "column", count(*) AS "rows", count(*) - count(id) AS nulls, max(id)::VARCHAR AS maximum FROM j
       UNION ALL SELECT 'label', count(*), count(*) - count(label), max(label)::VARCHAR FROM j
       UNION ALL SELECT 'quality', count(*), count(*) - count(quality), max(quality)::VARCHAR FROM j
       UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic), max(toxic)::VARCHAR FROM j""",
)
def profile_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return profile(_labelled(spark, folder))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    marks = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return vectors.join(marks, "id", "full_outer")


@query(
    "profile_null_cells",
    """SELECT CAST(sum((label IS NULL)::BIGINT + (quality IS NULL)::BIGINT + (toxic IS NULL)::BIGINT) AS BIGINT) AS null_cells
       FROM embeddings v FULL JOIN labels l ON v.vec_id = l.doc_id""",
)
def profile_null_cells(spark: SparkSession, folder: str) -> DataFrame:
    return null_cells(_labelled(spark, folder))


HEAVY_SHARE = 0.02


@query(
    "profile_heavy",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS "rows" FROM lineitem GROUP BY {c}
            HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM lineitem)"""
        for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    ),
)
def profile_heavy(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_labels(table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"], HEAVY_SHARE)


@query(
    "profile_distinct",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, TRUE AS within FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_linenumber")
    ),
)
def profile_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """The sketched numbers of different values, measured against the exact ones: within five standard errors."""
    columns, items = ["l_orderkey", "l_partkey", "l_linenumber"], table(spark, folder, "lineitem")
    exact = labels(items, columns).where("value IS NOT NULL").groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
    found = distinct_sketched(items, columns).join(exact, "column")
    off = F.abs(F.col("distinct_values") - F.col("exact"))
    return found.select("column", F.col("exact").alias("distinct_values"), (off <= 5 * distinct_error() * F.col("exact")).alias("within"))


@query(
    "profile_labels",
    """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS "rows" FROM orders GROUP BY o_orderstatus
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""",
)
def profile_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "param_filter",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice > 100000 AS is_large FROM orders
       WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_totalprice > 100000) = true""",
)
def param_filter(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("param_orders")
    found = bound_query(
        spark,
        "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice > 100000 AS is_large FROM param_orders "
        "WHERE o_orderstatus = :status AND o_orderpriority IN (:first, :second)",
        {"status": "P", "first": "1-URGENT", "second": "2-HIGH"},
    )
    return with_parameters(found, is_large=True)


@query(
    "latest_execution",
    f"""WITH {rel.EXECUTIONS_SQL}
    SELECT id AS execution_id, 'email_not_null' AS rule_name, 'not_null' AS rule_type, false AS passed,
           CAST(50 AS INTEGER) AS failed_count
    FROM executions ORDER BY start_time DESC NULLS FIRST, id DESC LIMIT 1""",
)
def latest_execution(spark: SparkSession, folder: str) -> DataFrame:
    newest = latest(rel.executions(spark, folder), ["start_time", "id"])
    constants = {c: model.EXAMPLE_VALIDATION[c] for c in ("rule_name", "rule_type", "passed", "failed_count")}
    picked = constants_for_match(newest, F.lit(True), "id", constants)
    return picked.withColumnRenamed("id", "execution_id")


@query(
    "insert_constants",
    """SELECT c_custkey AS pipeline_id, 'completed' AS status, CAST(1000 AS INTEGER) AS records_processed,
              CAST(50 AS INTEGER) AS records_failed, '{"duration_seconds": 45.2, "throughput": 22.2}' AS metrics
       FROM customer WHERE c_name = 'Customer#000000042' LIMIT 1""",
)
def insert_constants(spark: SparkSession, folder: str) -> DataFrame:
    picked = constants_for_match(
        rel.pipelines(spark, folder), F.col("name") == "Customer#000000042", "id", model.EXAMPLE_EXECUTION
    )
    return picked.withColumnRenamed("id", "pipeline_id")


@query(
    "scalar_functions",
    """SELECT event_id, event_type, CAST(length(trim('  ' || event_type || ' ')) AS INTEGER) AS trimmed,
              CAST(CASE WHEN value > 50 THEN 1 END AS INTEGER) AS entries,
              [event_type, 'x'] AS words,
              (value IS NULL OR value > 50) AS null_or_large,
              user_id + event_id + 1 <= 5000 AS within_bound,
              (CASE WHEN (CAST(round(value * 100) AS BIGINT) % 100) = 50
                    THEN 2 * ((CAST(round(value * 100) AS BIGINT) // 100 + 1) // 2)
                    ELSE (CAST(round(value * 100) AS BIGINT) + 50) // 100 END)::DOUBLE AS half_even,
              (CAST(round(value * 100) AS BIGINT) + 50) // 100 AS half_up,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              now()::DATE > ts::DATE AS clock_runs, length(uuid()::VARCHAR)::INTEGER AS uuid_length, n AS numeric_columns
       FROM events CROSS JOIN (
         SELECT CAST(count(*) AS INTEGER) AS n FROM (DESCRIBE events) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE'))""",
)
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    high = F.filter(F.array("value"), lambda v: v > 50)
    return events.select("*").select(
        "event_id",
        "event_type",
        trimmed_length(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("trimmed"),
        array_length(high).alias("entries"),
        F.array(F.col("event_type"), F.lit("x")).alias("words"),
        null_or("value", F.col("value") > 50).alias("null_or_large"),
        (sum_of(["user_id", "event_id"]) + 1 <= 5000).alias("within_bound"),
        money_round("value", 0).cast("double").alias("half_even"),
        F.round(F.col("value").cast("decimal(20,2)"), 0).cast("bigint").alias("half_up"),
        json_value("props", "$.k", "bigint").alias("k"),
        (F.current_date() > F.col("ts").cast("date")).alias("clock_runs"),
        F.length(F.uuid()).alias("uuid_length"),
        F.lit(len(numeric_columns(events))).alias("numeric_columns"),
    )
