"""Database reading through Spark's JDBC source, in parallel ranges of a key column."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PAGE_SIZE = 10_000
CATALOG_TABLES = "information_schema.tables"


@dataclass(frozen=True)
class KeyRange:
    """A numeric, date or timestamp column by whose ranges a scan is split."""

    column: str
    low: int | str
    high: int | str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.low),
            "upperBound": str(self.high),
            "numPartitions": str(self.partitions),
        }


def page_ranges(column: str, low: int, high: int, page_size: int = DEFAULT_PAGE_SIZE) -> KeyRange:
    """Ranges of about ``page_size`` keys each."""
    return KeyRange(column, low, high + 1, max(1, math.ceil((high - low + 1) / page_size)))


def source_options(
    url: str, query: str | None = None, table: str | None = None, ranges: KeyRange | None = None,
    connection: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of one scan; ``query`` wins over ``table``. A split query is read as a derived table."""
    if not query and not table:
        raise ValueError("Must provide either 'query' or 'table'")
    target = f"({query.rstrip().rstrip(';')}) source_query" if query else table
    return {"url": url, "dbtable": target, **(ranges.options() if ranges else {}), **dict(connection or {})}


def read_jdbc(
    spark: SparkSession, url: str, query: str | None = None, table: str | None = None, ranges: KeyRange | None = None,
    connection: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table or query result. Filters and column choices on the result are pushed into the database's SQL."""
    return spark.read.format("jdbc").options(**source_options(url, query, table, ranges, connection)).load()


def bounds_query(query: str, key: str) -> str:
    """The smallest and largest key of a query result, found by the database."""
    return f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM ({query.rstrip().rstrip(';')}) keyed"


def read_jdbc_paged(
    spark: SparkSession, url: str, query: str, key: str, page_size: int = DEFAULT_PAGE_SIZE,
    connection: Mapping[str, str] | None = None,
) -> DataFrame:
    """The whole query result, split by ranges of an integer key; the database scans each range once.

    An empty result keeps its columns.
    """
    low, high = read_jdbc(spark, url, bounds_query(query, key), connection=connection).first()
    ranges = None if low is None else page_ranges(key, int(low), int(high), page_size)
    return read_jdbc(spark, url, query, ranges=ranges, connection=connection)


def list_tables(
    spark: SparkSession, url: str, schema: str = "public", connection: Mapping[str, str] | None = None
) -> DataFrame:
    """The names of a schema's tables, sorted."""
    catalog = read_jdbc(spark, url, table=CATALOG_TABLES, connection=connection)
    return tables_of(catalog, [schema])


def tables_of(catalog: DataFrame, schemas: list[str]) -> DataFrame:
    return catalog.where(F.col("table_schema").isin(schemas)).select("table_name").orderBy("table_name")


def list_views(spark: SparkSession, database: str = "default") -> DataFrame:
    """The names of the tables and views that this session knows, sorted."""
    return spark.sql("SHOW TABLES IN IDENTIFIER(:name)", args={"name": database}).select(
        F.col("tableName").alias("table_name")
    ).orderBy("table_name")


def with_parameters(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters on bound values; a JDBC scan sends them to the database."""
    condition: Column = F.lit(True)
    for column, value in equal.items():
        condition = condition & (F.col(column) == F.lit(value))
    return df.where(condition)


def bound_query(spark: SparkSession, sql: str, parameters: Mapping[str, object] | list) -> DataFrame:
    """An SQL query over registered views with named (``:name``) or positional (``?``) parameters."""
    return spark.sql(sql, args=parameters)
