"""What the operators of this subpackage share: words, Arrow batches, registered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

#: A word is a run of anything but these six ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query of this subpackage."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def row_hash(df: DataFrame, inside: str) -> Column:
    """Hash of all hashable columns of ``df``, which stand in the struct column ``inside``."""
    names = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[F.col(inside)[name] for name in names])


def n_words(column: str | Column) -> Column:
    """Number of words, in the JVM."""
    return F.size(F.filter(F.split(text_of(column), GAP), lambda w: w != F.lit(""))).cast("bigint")


def split_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: ``bytes.split`` parts at exactly the six separators of ``WORD``."""
    return text.split()


def numbered(items: Iterable) -> np.ndarray:
    """Each item's number, counted by first appearance."""
    numbers: dict = {}
    fresh = count()
    out = []
    for item in items:
        number = numbers.get(item)
        if number is None:
            number = numbers[item] = next(fresh)
        out.append(number)
    return np.array(out, dtype=np.int64)


def arrow_type(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``rows`` takes and gives batches as columns of Python values or numpy arrays."""
    spark_schema = T._parse_datatype_string(schema)
    arrow = arrow_type(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict[str, list]]:
            for batch in batches:
                if batch.num_rows:
                    yield {name: batch.column(i) for i, name in enumerate(batch.schema.names)}

        for out in rows(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a text column as bytes; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
