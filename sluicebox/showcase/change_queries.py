"""Inserts, updates, deletes, defaults and unions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.operators.buckets import delete_bucketed, insert_bucketed, read_bucketed, upsert_bucketed, write_bucketed
from sluicebox.operators.sinks import ForeignKey, bag_union, delete, insert_if_absent, upsert, with_defaults
from sluicebox.scratch import scratch_path
from sluicebox.showcase.registry import query, table

LINKS = (
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
)
LOOSE_LINKS = (ForeignKey("orders", "o_custkey", "customer", "c_custkey", on_delete="set_null"),)


@query(
    "insert_if_absent",
    """WITH have AS (SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'),
            new AS (SELECT c_name, 0.0::DOUBLE AS c_acctbal FROM customer
                    UNION ALL SELECT c_name, 1.0::DOUBLE FROM customer)
       SELECT * FROM have UNION ALL
       SELECT c_name, min(c_acctbal) FROM new WHERE c_name NOT IN (SELECT c_name FROM have) GROUP BY c_name""",
)
def absent_customers(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    have = customers.where("c_mktsegment <> 'BUILDING'").select("c_name", "c_acctbal")
    new = customers.select("c_name", F.explode(F.array(F.lit(1.0), F.lit(0.0))).alias("c_acctbal"))
    return insert_if_absent(have, new, ["c_name"])


@query(
    "upsert_stamped",
    """WITH target AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, TIMESTAMP '2024-01-01' AS updated_at FROM customer),
            changes AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal + 100 END AS c_acctbal FROM customer
                        WHERE c_mktsegment = 'BUILDING'
                        UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier)
       SELECT coalesce(t.c_custkey, c.c_custkey) AS c_custkey, t.c_name,
              CASE WHEN c.c_custkey IS NOT NULL THEN c.c_acctbal ELSE t.c_acctbal END AS c_acctbal, t.c_mktsegment,
              CASE WHEN c.c_custkey IS NOT NULL THEN TIMESTAMP '2025-01-01' ELSE t.updated_at END AS updated_at
       FROM target t FULL JOIN changes c ON t.c_custkey = c.c_custkey""",
)
def upsert_stamped(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    target = customers.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    raised = customers.where("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") + 100).alias("c_acctbal")
    )
    added = table(spark, folder, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert(target, raised.unionByName(added), ["c_custkey"], dt.datetime(2025, 1, 1))


@query(
    "upsert_bucketed",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 < 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
              CASE WHEN o_orderkey % 1000 < 7 THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
       FROM orders WHERE o_orderkey % 1000 <> 8
       UNION ALL SELECT -1 - s_suppkey, 'new', NULL, TIMESTAMP '2025-01-01' FROM supplier WHERE s_suppkey % 10 = 3""",
)
def upsert_in_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders stored in buckets; some are changed, some added, some deleted, each in place."""
    path = scratch_path(spark, "orders")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    write_bucketed(orders.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz")), path, ["o_orderkey"], 64)
    changed = orders.where("o_orderkey % 1000 < 7").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    upsert_bucketed(spark, path, changed, ["o_orderkey"], now=dt.datetime(2025, 1, 1))
    added = table(spark, folder, "supplier").where("s_suppkey % 10 = 3").select(
        (-1 - F.col("s_suppkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"), F.lit("2025-01-01").cast("timestamp_ntz").alias("updated_at")
    )
    insert_bucketed(spark, path, added, ["o_orderkey"])
    delete_bucketed(spark, path, orders.where("o_orderkey % 1000 = 8"), ["o_orderkey"])
    return read_bucketed(spark, path)


def _after_delete(spark: SparkSession, folder: str, links) -> dict[str, DataFrame]:
    tables = {name: table(spark, folder, name) for name in ("customer", "orders", "lineitem")}
    return delete(tables, links, "customer", tables["customer"].where("c_acctbal < 0"), "c_custkey")


KEPT_ORDERS = "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@query("delete_cascade_parent", "SELECT * FROM customer WHERE NOT c_acctbal < 0")
def delete_cascade_parent(spark: SparkSession, folder: str) -> DataFrame:
    return _after_delete(spark, folder, LINKS)["customer"]


@query("delete_cascade_child", f"SELECT * FROM orders WHERE {KEPT_ORDERS}")
def delete_cascade_child(spark: SparkSession, folder: str) -> DataFrame:
    return _after_delete(spark, folder, LINKS)["orders"]


@query(
    "delete_cascade_grandchild",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {KEPT_ORDERS})""",
)
def delete_cascade_grandchild(spark: SparkSession, folder: str) -> DataFrame:
    left = _after_delete(spark, folder, LINKS)["lineitem"]
    return left.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "delete_set_null",
    f"SELECT o_orderkey, CASE WHEN {KEPT_ORDERS} THEN o_custkey END AS o_custkey, o_orderstatus FROM orders",
)
def delete_set_null(spark: SparkSession, folder: str) -> DataFrame:
    return _after_delete(spark, folder, LOOSE_LINKS)["orders"].select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "defaults_filled",
    """SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS status, true AS is_active,
              CAST(0 AS INTEGER) AS records_processed, '{}' AS config, CAST(NULL AS VARCHAR) AS error_message FROM customer""",
)
def defaults_filled(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType.fromDDL(
        "id bigint, status string, is_active boolean, records_processed int, config string, error_message string"
    )
    values = {"status": F.lit("pending"), "is_active": F.lit(True), "records_processed": F.lit(0), "config": F.lit("{}")}
    given = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("status")
    )
    return with_defaults(given, schema, values)


@query(
    "bag_union",
    """SELECT o_orderkey, o_orderstatus FROM orders UNION ALL
       SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'""",
)
def union_of_slices(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    by_status = [orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P", "P", "no such status")]
    return bag_union(by_status)
