"""Newest row per key, and newest rows overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per(df: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The row with the largest ``newest`` columns for each key, found by partial aggregation."""
    rest = [c for c in df.columns if c not in key and c not in newest]
    top = F.max(F.struct(*newest, *rest)).alias("_top")
    return df.groupBy(*key).agg(top).select(*[F.col(c) if c in key else F.col(f"_top.{c}").alias(c) for c in df.columns])


def latest(df: DataFrame, newest: Sequence[str], n: int = 1) -> DataFrame:
    """The ``n`` newest rows; unknown times come first, as in ``ORDER BY ... DESC`` of the relational model."""
    return df.orderBy(*[F.desc_nulls_first(c) for c in newest]).limit(n)
