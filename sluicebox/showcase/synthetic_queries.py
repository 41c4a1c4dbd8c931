"""Synthetic rows for the keys of the given tables, and corruption of the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators import corrupt
from sluicebox.operators.generate import (
    CUSTOMER_SCHEMA, CUSTOMERS, PREDEFINED_SCHEMAS, TRANSACTION_SCHEMA, TRANSACTIONS, ColumnSpec, Reference, generate_for,
)
from sluicebox.operators.sinks import write_csv
from sluicebox.plans.sample_job import ANOMALY_SCHEMA
from sluicebox.scratch import scratch_path
from sluicebox.showcase.registry import query, table
from sluicebox.showcase.synthetic_sql import CorruptionSql, table_sql
from sluicebox.sources.delimited import read_csv

SEED = 42
AS_OF = dt.datetime(2025, 3, 1, 9, 30, 15, 123456)


def _add(name: str, schema: dict[str, ColumnSpec], source: str, key: str, locale: str = "es_ES", stream: str = "") -> None:
    """Register a synthetic table with one row per row of ``source``."""

    @query(name, table_sql(schema, source, key, SEED, AS_OF, locale, f"{key} AS row_id", stream))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        keep = [F.col(key).alias("row_id")]
        return generate_for(table(spark, folder, source), [key], schema, SEED, AS_OF, locale, keep, stream)


def _words(*names: str) -> dict[str, ColumnSpec]:
    return {f"{n}_col": n for n in names}


_add("gen_numeric", _words("int", "float", "bool", "amount", "price", "boolean"), "orders", "o_orderkey")
_add("gen_decimal", _words("decimal"), "orders", "o_orderkey")
_add("gen_text", _words("string", "word", "sentence", "text"), "orders", "o_orderkey")
_add("gen_person", _words("name", "email", "phone", "address", "company", "first_name", "last_name"), "orders", "o_orderkey")
_add("gen_place", _words("city", "country", "currency_code", "phone_number", "random_element"), "orders", "o_orderkey")
_add("gen_temporal", _words("date", "datetime", "timestamp", "date_time"), "orders", "o_orderkey")
_add("gen_uuid", _words("uuid"), "orders", "o_orderkey")
_add("gen_category", _words("category"), "orders", "o_orderkey")
_add("gen_unknown_word", {"x": "no such type"}, "orders", "o_orderkey")
_add("gen_locale", _words("name", "email", "phone", "address", "company", "sentence"), "customer", "c_custkey", "en_US")
_add("gen_customers", CUSTOMER_SCHEMA, "customer", "c_custkey", stream=CUSTOMERS)
_add("gen_transactions", TRANSACTION_SCHEMA, "orders", "o_orderkey", stream=TRANSACTIONS)
LINKED = TRANSACTION_SCHEMA | {"customer_id": Reference(CUSTOMERS + "customer_id", 100)}
_add("gen_linked_transactions", LINKED, "orders", "o_orderkey", stream=TRANSACTIONS)
for _name, _source, _key in (("customers", "customer", "c_custkey"), ("transactions", "orders", "o_orderkey"), ("products", "part", "p_partkey")):
    _add(f"gen_predefined_{_name}", PREDEFINED_SCHEMAS[_name], _source, _key, stream=f"{_name}.")


CUSTOMER_COLUMNS = {
    "c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INTEGER", "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR",
}
CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]
ORDER_COLUMNS = {
    "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE",
    "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR",
}
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _share(rate: str, kinds: int) -> str:
    return f"(CAST(floor((SELECT n FROM size) * {rate}) AS BIGINT) // {kinds})"


def _customer_sql() -> CorruptionSql:
    return CorruptionSql("customer", CUSTOMER_COLUMNS, "c_custkey", SEED)


def _order_sql() -> CorruptionSql:
    return CorruptionSql("orders", ORDER_COLUMNS, "o_orderkey", SEED)


def _nulls() -> str:
    s = _order_sql()
    s.nulls(_share("0.1::DOUBLE", 1))
    return s.sql()


@query("ano_nulls", _nulls())
def ano_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return corrupt.inject_anomalies(table(spark, folder, "orders"), ["o_orderkey"], 0.1, ["nulls"], SEED)


def _outliers(compound: bool) -> str:
    s = _customer_sql()
    s.outliers(_share("0.05::DOUBLE", 1), CUSTOMER_NUMBERS, compound)
    return s.sql()


@query("ano_outliers", _outliers(True))
def ano_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return corrupt.inject_anomalies(table(spark, folder, "customer"), ["c_custkey"], 0.05, ["outliers"], SEED)


@query("ano_outliers_flat", _outliers(False))
def ano_outliers_flat(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return corrupt.inject_anomalies(customers, ["c_custkey"], 0.05, ["outliers"], SEED, compound=False)


def _duplicates() -> str:
    s = _order_sql()
    s.duplicates(_share("0.1::DOUBLE", 1))
    return s.sql()


@query("ano_duplicates", _duplicates())
def ano_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return corrupt.inject_anomalies(table(spark, folder, "orders"), ["o_orderkey"], 0.1, ["duplicates"], SEED)


def _composite() -> str:
    """The key is a text that holds the separator of key parts, and a number."""
    source = "(SELECT *, c_mktsegment || '|' || c_nationkey AS label FROM customer)"
    s = CorruptionSql(source, CUSTOMER_COLUMNS, "replace(label, '|', '\\|') || '|' || c_custkey", SEED)
    s.nulls(_share("0.1::DOUBLE", 2))
    s.duplicates(_share("0.1::DOUBLE", 2))
    return s.sql()


@query("ano_composite_key", _composite())
def ano_composite_key(spark: SparkSession, folder: str) -> DataFrame:
    label = F.concat_ws("|", "c_mktsegment", "c_nationkey")
    customers = table(spark, folder, "customer").withColumn("label", label)
    # The label only identifies rows: it is left out of what is corrupted.
    names = list(CUSTOMER_COLUMNS)
    keyed = customers.select(*names, F.col("c_custkey").alias("number"), "label")
    return corrupt.inject_anomalies(keyed, ["label", "number"], 0.1, ["nulls", "duplicates"], SEED, drop_key=True)


def _all() -> str:
    s = _customer_sql()
    share = _share("0.1::DOUBLE", 3)
    s.nulls(share)
    s.outliers(share, CUSTOMER_NUMBERS)
    s.duplicates(share)
    return s.sql()


@query("ano_all", _all())
def ano_all(spark: SparkSession, folder: str) -> DataFrame:
    return corrupt.inject_anomalies(table(spark, folder, "customer"), ["c_custkey"], 0.1, None, SEED)


def _type_errors() -> str:
    s = _order_sql()
    s.type_errors(_share("0.02::DOUBLE", 1), ["o_custkey"], corrupt.TYPE_ERROR_TOKEN)
    return s.sql()


@query("ano_type_errors", _type_errors())
def ano_type_errors(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return corrupt.inject_type_errors(orders, int(orders.count() * 0.02), ["o_orderkey"], SEED, ["o_custkey"])


def _targeted() -> str:
    s = _order_sql()
    s.outliers(_share("0.05::DOUBLE", 1), ["o_totalprice"], compound=False)
    return s.sql()


@query("ano_targeted", _targeted())
def ano_targeted(spark: SparkSession, folder: str) -> DataFrame:
    return corrupt.poison(table(spark, folder, "orders"), ["o_orderkey"], 0.05, ["o_totalprice"], SEED)


SAMPLE_COLUMNS = {"id": "BIGINT", "name": "VARCHAR", "email": "VARCHAR", "amount": "DOUBLE", "date": "DATE"}


def _sample() -> str:
    source = table_sql(ANOMALY_SCHEMA, "orders", "o_orderkey", SEED, AS_OF, keep="o_orderkey AS row_id")
    s = CorruptionSql(f"({source})", SAMPLE_COLUMNS, "row_id", SEED)
    share = _share("0.1::DOUBLE", 3)
    s.nulls(share)
    s.outliers(share, ["id", "amount"], compound=False)
    s.duplicates(share)
    return "SELECT id, name, email, amount, CAST(date AS VARCHAR) AS date FROM (" + s.sql() + ")"


@query("sample_with_anomalies", _sample())
def sample_with_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """The sample job's third table, one row per order, through a CSV file and back."""
    keep = [F.col("o_orderkey").alias("row_id")]
    clean = generate_for(table(spark, folder, "orders"), ["o_orderkey"], ANOMALY_SCHEMA, SEED, AS_OF, keep=keep)
    spoiled = corrupt.inject_anomalies(clean, ["row_id"], 0.1, None, SEED, compound=False, drop_key=True)
    path = scratch_path(spark, "sample")
    write_csv(spoiled, path)
    return read_csv(spark, path)
