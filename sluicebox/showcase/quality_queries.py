"""Quality rules, their results, and quarantine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.scalars import json_value
from sluicebox.operators import rules as R
from sluicebox.operators.incremental import check_changed
from sluicebox.plans import model, views
from sluicebox.scratch import scratch_path
from sluicebox.showcase import relations as rel
from sluicebox.showcase.registry import query, table


def _one(name: str, kind: str, condition: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS rule_name, '{kind}' AS rule_type, "
        f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT) AS failed_count FROM {source}"
    )


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a segment that is sometimes unknown and a note that is sometimes blank."""
    segment = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        "*", F.nullif(segment, F.lit("BUILDING")).alias("segment"), F.replace(segment, F.lit("MACHINERY"), F.lit("  ")).alias("note")
    )


CUSTOMERS = (
    "(SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment, replace(c_mktsegment, 'MACHINERY', '  ') AS note FROM customer)"
)


@query("dq_not_null", _one("segment_not_null", "not_null", "segment IS NULL", CUSTOMERS))
def dq_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(_customers(spark, folder), [R.not_null("segment")])


@query("dq_not_blank", _one("note_not_blank", "not_blank", "NOT length(trim(note)) > 0", CUSTOMERS))
def dq_not_blank(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(_customers(spark, folder), [R.not_blank("note")])


@query("dq_max_length", _one("segment_max_length", "max_length", "length(segment) > 9", CUSTOMERS))
def dq_max_length(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(_customers(spark, folder), [R.max_length("segment", 9)])


UNIQUE_PAIRS = (
    "SELECT 'l_orderkey_l_linenumber_unique' AS rule_name, 'unique' AS rule_type, "
    "CAST(coalesce(sum(n), 0) AS BIGINT) AS failed_count FROM "
    "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"
)


@query("dq_unique_pairs", UNIQUE_PAIRS)
def dq_unique_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(table(spark, folder, "lineitem"), [R.unique("l_orderkey", "l_linenumber")])


@query(
    "dq_unique_nullable",
    "SELECT 'segment_unique' AS rule_name, 'unique' AS rule_type, CAST(sum(n) AS BIGINT) AS failed_count FROM "
    f"(SELECT count(*) AS n FROM {CUSTOMERS} WHERE segment IS NOT NULL GROUP BY segment HAVING count(*) > 1)",
)
def dq_unique_nullable(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(_customers(spark, folder), [R.unique("segment")])


@query("dq_accepted_values", _one("o_orderstatus_accepted", "accepted_values", "o_orderstatus NOT IN ('O', 'F')", "orders"))
def dq_accepted_values(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(table(spark, folder, "orders"), [R.accepted_values("o_orderstatus", ["O", "F"])])


@query("dq_range", _one("l_discount_range", "range", "NOT l_discount BETWEEN 0.02 AND 0.08", "lineitem"))
def dq_range(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(table(spark, folder, "lineitem"), [R.in_range("l_discount", 0.02, 0.08)])


@query("dq_min_value", _one("c_acctbal_min", "min_value", "c_acctbal < 0", "customer"))
def dq_min_value(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(table(spark, folder, "customer"), [R.min_value("c_acctbal", 0)])


@query(
    "dq_ordered",
    f"WITH {rel.EXECUTIONS_SQL} " + _one("end_time_after_start_time", "ordered", "end_time < start_time", "executions"),
)
def dq_ordered(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(rel.executions(spark, folder), [R.ordered("start_time", "end_time")])


@query(
    "dq_sum_bound",
    f"WITH {rel.SIMULATIONS_SQL} "
    + _one("attempts_total_bounds_parts", "sum_at_most", "attempts_detected + attempts_blocked > attempts_total", "simulations"),
)
def dq_sum_bound(spark: SparkSession, folder: str) -> DataFrame:
    rule = R.sum_at_most(["attempts_detected", "attempts_blocked"], "attempts_total")
    return R.failed_counts(rel.simulations(spark, folder), [rule])


@query("dq_decimal", _one("l_extendedprice_decimal", "fits_decimal", "l_extendedprice >= 9999.995", "lineitem"))
def dq_decimal(spark: SparkSession, folder: str) -> DataFrame:
    return R.failed_counts(table(spark, folder, "lineitem"), [R.fits_decimal("l_extendedprice", 6, 2)])


@query(
    "dq_decimal_wide",
    " UNION ALL ".join(
        _one(f"{c}_decimal", "fits_decimal", f"{c} >= {bound}", "(SELECT c_custkey * 1e17 AS value, c_custkey * 1e35 AS large FROM customer)")
        for c, bound in (("value", "1e20"), ("large", "1e38"))
    ),
)
def dq_decimal_wide(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey").cast("double")
    values = table(spark, folder, "customer").select((key * 1e17).alias("value"), (key * 1e35).alias("large"))
    return R.failed_counts(values, [R.fits_decimal("value", 38, 18), R.fits_decimal("large", 38, 0)])


@query(
    "dq_array_not_empty",
    _one("large_not_empty", "not_empty", "len(list_filter(embedding, lambda x: x > 0.3::FLOAT)) = 0", "embeddings"),
)
def dq_array_not_empty(spark: SparkSession, folder: str) -> DataFrame:
    large = F.filter("embedding", lambda x: x > F.lit(0.3).cast("float"))
    return R.failed_counts(table(spark, folder, "embeddings").select(large.alias("large")), [R.not_empty("large")])


@query("dq_uuid_text", _one("identity_uuid", "uuid_text", "c_acctbal < 0", "customer"))
def dq_uuid_text(spark: SparkSession, folder: str) -> DataFrame:
    text = F.md5(F.col("c_name"))
    parts = [F.substring(text, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    identity = F.when(F.col("c_acctbal") < 0, text).otherwise(F.concat_ws("-", *parts))
    return R.failed_counts(table(spark, folder, "customer").select(identity.alias("identity")), [R.uuid_text("identity")])


@query(
    "dq_references",
    "SELECT 'o_orderkey_references' AS rule_name, 'references' AS rule_type, count(*) AS failed_count FROM orders o "
    "WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)
def dq_references(spark: SparkSession, folder: str) -> DataFrame:
    rule = R.references("o_orderkey", table(spark, folder, "lineitem"), "l_orderkey")
    return R.failed_counts(table(spark, folder, "orders"), [rule])


@query(
    "dq_references_clean",
    "SELECT 'l_orderkey_references' AS rule_name, 'references' AS rule_type, count(*) AS failed_count FROM lineitem l "
    "WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE l.l_orderkey = o.o_orderkey)",
)
def dq_references_clean(spark: SparkSession, folder: str) -> DataFrame:
    rule = R.references("l_orderkey", table(spark, folder, "orders"), "o_orderkey")
    return R.failed_counts(table(spark, folder, "lineitem"), [rule])


def _line_rules() -> list[R.Rule]:
    return [
        R.not_null("l_orderkey"),
        R.in_range("l_quantity", 1, 45),
        R.in_range("l_discount", 0.0, 0.09),
        R.min_value("l_extendedprice", 1000),
        R.accepted_values("l_returnflag", ["A", "N"]),
        R.max_length("l_linestatus", 1),
        R.fits_decimal("l_extendedprice", 7, 2),
        R.unique("l_orderkey", "l_linenumber"),
    ]


LINE_CONDITIONS = [
    ("l_orderkey_not_null", "not_null", "l_orderkey IS NULL", ["l_orderkey"]),
    ("l_quantity_range", "range", "NOT l_quantity BETWEEN 1 AND 45", ["l_quantity"]),
    ("l_discount_range", "range", "NOT l_discount BETWEEN 0.0 AND 0.09", ["l_discount"]),
    ("l_extendedprice_min", "min_value", "l_extendedprice < 1000", ["l_extendedprice"]),
    ("l_returnflag_accepted", "accepted_values", "l_returnflag NOT IN ('A', 'N')", ["l_returnflag"]),
    ("l_linestatus_max_length", "max_length", "length(l_linestatus) > 1", ["l_linestatus"]),
    ("l_extendedprice_decimal", "fits_decimal", "l_extendedprice >= 99999.995", ["l_extendedprice"]),
]

DQ_RESULTS = (
    "WITH r AS ("
    + " UNION ALL ".join(_one(n, k, c, "lineitem") for n, k, c, _ in LINE_CONDITIONS)
    + f" UNION ALL {UNIQUE_PAIRS}) "
    "SELECT md5('run-1|' || rule_name) AS id, 'run-1' AS execution_id, rule_name, rule_type, failed_count = 0 AS passed, "
    "failed_count, CASE WHEN failed_count = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(CASE rule_name "
    + " ".join(f"WHEN '{n}' THEN {c}" for n, _, _, c in LINE_CONDITIONS)
    + " ELSE ['l_orderkey', 'l_linenumber'] END, lambda c: '{\"column\":\"' || c || '\",\"count\":' || failed_count || '}'), ',') || ']' END "
    "AS failure_details, TIMESTAMP '2025-01-01' AS timestamp FROM r"
)


@query("dq_results", DQ_RESULTS)
def dq_results(spark: SparkSession, folder: str) -> DataFrame:
    return R.validate(table(spark, folder, "lineitem"), _line_rules(), "run-1", dt.datetime(2025, 1, 1))


DETAIL_RULES = [
    ("c_acctbal_min", "c_acctbal < 0", "c_acctbal", "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)"),
    ("segment_not_null", "segment IS NULL", "segment", "NULL"),
]


@query(
    "dq_details",
    " UNION ALL ".join(
        f"SELECT md5('run-1|{n}') AS result_id, '{n}' AS rule_name, CAST(c_custkey AS VARCHAR) AS row, '{c}' AS \"column\", "
        f"{v} AS value FROM {CUSTOMERS} WHERE {w}"
        for n, w, c, v in DETAIL_RULES
    ),
)
def dq_details(spark: SparkSession, folder: str) -> DataFrame:
    customers = _customers(spark, folder).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))
    return R.failure_rows(customers, [R.min_value("c_acctbal", 0), R.not_null("segment")], ["c_custkey"], "run-1")


@query(
    "dq_violations",
    "WITH u AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1), v AS ("
    "SELECT 'l_quantity_range' AS rule_name, l_orderkey || '|' || l_linenumber AS row, 'l_quantity' AS \"column\", "
    "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 45 "
    "UNION ALL SELECT 'l_orderkey_l_linenumber_unique', l_orderkey || '|' || l_linenumber, 'l_orderkey', "
    "CAST(l_orderkey AS VARCHAR) FROM lineitem SEMI JOIN u USING (l_orderkey, l_linenumber) "
    "UNION ALL SELECT 'l_orderkey_l_linenumber_unique', l_orderkey || '|' || l_linenumber, 'l_linenumber', "
    "CAST(l_linenumber AS VARCHAR) FROM lineitem SEMI JOIN u USING (l_orderkey, l_linenumber)) SELECT * FROM v",
)
def dq_violations(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    rules = [R.in_range("l_quantity", 1, 45), R.unique("l_orderkey", "l_linenumber")]
    return R.violations(lines, rules, ["l_orderkey", "l_linenumber"])


_BROKEN_NAMES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c, _ in LINE_CONDITIONS) + "], lambda x: x IS NOT NULL)"


@query(
    "dq_quarantine",
    f"""WITH u AS (SELECT l_orderkey, l_linenumber, count(*) > 1 AS dup FROM lineitem GROUP BY ALL),
    m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
                 list_concat({_BROKEN_NAMES}, CASE WHEN dup THEN ['l_orderkey_l_linenumber_unique'] ELSE [] END) AS broken
          FROM lineitem JOIN u USING (l_orderkey, l_linenumber))
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, array_to_string(broken, ',') AS violations FROM m
    WHERE len(broken) > 0""",
)
def dq_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = R.split(table(spark, folder, "lineitem"), _line_rules())
    names = F.array_join(R.MARK, ",").alias("violations")
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", names)


@query(
    "dq_good_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l WHERE NOT ("
    + " OR ".join(f"coalesce({c}, false)" for _, _, c, _ in LINE_CONDITIONS)
    + ") AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')",
)
def dq_good_rows(spark: SparkSession, folder: str) -> DataFrame:
    closed = table(spark, folder, "orders").where("o_orderstatus <> 'P'")
    rules = [*R.row_rules(_line_rules()), R.references("l_orderkey", closed, "o_orderkey")]
    good, _ = R.split(table(spark, folder, "lineitem"), rules)
    return good.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "dq_config",
    " UNION ALL ".join(
        _one(f"{c}_not_null", "not_null", f"{c} IS NULL", CUSTOMERS) for c in ("segment", "c_custkey")
    )
    + f" UNION ALL SELECT 'segment_unique', 'unique', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM {CUSTOMERS} "
    "WHERE segment IS NOT NULL GROUP BY segment HAVING count(*) > 1) "
    "UNION ALL SELECT 'c_custkey_unique', 'unique', count(*) - count(DISTINCT c_custkey) FROM customer "
    "UNION ALL " + _one("c_acctbal_range", "range", "NOT c_acctbal BETWEEN 0 AND 5000", "customer")
    + " UNION ALL SELECT 'c_custkey_references', 'references', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def dq_config(spark: SparkSession, folder: str) -> DataFrame:
    config = (
        '{"source": "postgresql", "validations": ["not_null", "unique", {"rule": "range", "args": ["c_acctbal", 0, 5000]}, '
        '{"rule": "references", "args": ["c_custkey", "orders", "o_custkey"]}]}'
    )
    rules = R.rules_from_config(config, ["segment", "c_custkey"], {"orders": table(spark, folder, "orders")})
    return R.failed_counts(_customers(spark, folder), rules)


_BROKEN = " OR ".join(f"coalesce({c}, false)" for _, _, c, _ in LINE_CONDITIONS) + " OR times > 1"
_TIMED_LINES = "(SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS times FROM lineitem)"


@query(
    "dq_counters",
    f"SELECT count(*) AS records_processed, count(*) FILTER (WHERE {_BROKEN}) AS records_failed FROM {_TIMED_LINES}",
)
def dq_counters(spark: SparkSession, folder: str) -> DataFrame:
    return R.run_counters(table(spark, folder, "lineitem"), _line_rules())


@query(
    "checked_run",
    f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_BROKEN}) AS f FROM {_TIMED_LINES}) "
    "SELECT 'run-1' AS id, 'lines' AS pipeline_name, "
    "CASE WHEN f > 0 THEN 'failed' ELSE 'completed' END AS status, 45.2::DOUBLE AS duration_seconds, "
    f"n AS records_processed, f AS records_failed, {rel.half_up('10000 * f', 'n')} / 100.0::DOUBLE AS failure_rate_percent, "
    "round(n / 45.2::DOUBLE, 2) AS throughput FROM c",
)
def checked_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run over the line items, from its rules to its row in the execution summary."""
    start = dt.datetime(2025, 1, 1)
    run = model.execution_of(
        table(spark, folder, "lineitem"), _line_rules(), "run-1", "p-1", start, start + dt.timedelta(seconds=45.2)
    )
    pipeline = spark.createDataFrame([("p-1", "lines")], "id string, name string")
    return views.execution_summary(run, pipeline).select(
        "id",
        "pipeline_name",
        "status",
        "duration_seconds",
        "records_processed",
        "records_failed",
        F.col("failure_rate_percent").cast("double").alias("failure_rate_percent"),
        json_value("metrics", "$.throughput", "double").alias("throughput"),
    )


_CHANGED = "(SELECT * FROM orders WHERE o_orderkey % 8 <> 2 UNION ALL SELECT * FROM orders WHERE o_orderkey % 8 = 1)"


@query(
    "dq_incremental",
    f"""SELECT rule_name, rule_type, failed_count, records_processed, 8 + 1 AS files, 2 AS files_read FROM (
        {_one("o_totalprice_range", "range", "NOT o_totalprice BETWEEN 1000 AND 400000", _CHANGED)}
        UNION ALL {_one("o_orderstatus_accepted", "accepted_values", "o_orderstatus NOT IN ('O', 'F')", _CHANGED)}
        UNION ALL SELECT 'o_orderkey_unique', 'unique', CAST(coalesce(sum(n), 0) AS BIGINT)
        FROM (SELECT count(*) AS n FROM {_CHANGED} GROUP BY o_orderkey HAVING count(*) > 1)
        UNION ALL SELECT 'o_custkey_references', 'references', count(*) FROM {_CHANGED}
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')),
        (SELECT count(*) AS records_processed FROM {_CHANGED})""",
)
def dq_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in eight files; then one is replaced by nothing, one comes twice, and a run reads these two files only."""
    stored, store = scratch_path(spark, "orders"), scratch_path(spark, "results")
    orders = table(spark, folder, "orders").withColumn("piece", F.pmod("o_orderkey", F.lit(8)).cast("int"))
    known = table(spark, folder, "customer").where(F.col("c_mktsegment") != "BUILDING")
    rules = [
        R.in_range("o_totalprice", 1000, 400000), R.accepted_values("o_orderstatus", ["O", "F"]), R.unique("o_orderkey"),
        R.references("o_custkey", known, "c_custkey"),
    ]
    orders.repartition("piece").write.partitionBy("piece").parquet(stored)
    check_changed(spark, stored, rules, store)
    orders.where("false").drop("piece").coalesce(1).write.mode("overwrite").parquet(f"{stored}/piece=2")
    orders.where("piece = 1").drop("piece").coalesce(1).write.parquet(f"{stored}/piece=9")
    found = check_changed(spark, stored, rules, store)
    counts = {"records_processed": found.counters.first()["records_processed"], "files": found.files, "files_read": found.files_read}
    return found.results.select("*", *[F.lit(n).cast("int" if "files" in c else "bigint").alias(c) for c, n in counts.items()])
