"""Keys of a table: counted before they move, and joined without losing rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(columns: Sequence[str]) -> Column:
    """None of the columns is null."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each key without nulls and its number of ``rows``; counting starts inside each task."""
    return df.where(present(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))


def flag_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """``df`` with boolean column ``name``: the key of the row is among ``keys``, which has each key once.

    An outer join that keeps all rows of ``df``; adaptive execution broadcasts few keys and splits a frequent one.
    """
    joined = df.join(keys.select(*on, F.lit(True).alias(name)), list(on), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(name), F.lit(False)).alias(name))
