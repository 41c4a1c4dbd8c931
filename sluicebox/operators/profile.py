"""Counts and extremes of a table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.operators.corrupt import comparable, numeric_columns
from sluicebox.scratch import written

DISTINCT_BITS = 14  # buckets of a distinct-count sketch, as a power of two


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and the maximum of numeric columns, in a single pass.

    The maximum is the text of a value of the column's own type, so that no digit is lost; NaN is no maximum.
    """
    numeric = set(numeric_columns(df))
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        measures.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"))
        if c in numeric:
            measures.append(F.max(comparable(df, c)).cast("string").alias(f"m{i}"))
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("rows").alias("rows"),
            F.col(f"n{i}").alias("nulls"),
            (F.col(f"m{i}") if c in numeric else F.lit(None).cast("string")).alias("maximum"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def null_cells(df: DataFrame) -> DataFrame:
    """The total number of null cells."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).select(
        sum((F.col(f"n{i}") for i in range(1, len(df.columns))), F.col("n0")).alias("null_cells")
    )


def labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows): the distinct values of the named columns with their number of rows."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*entries))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    )


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """The relative standard error of ``distinct_sketched``: 0.8 % for 14 bits."""
    return 1.04 / math.sqrt(2**bits)


def distinct_sketched(df: DataFrame, columns: Sequence[str], bits: int = DISTINCT_BITS) -> DataFrame:
    """(column, distinct_values): about how many different values each column has, of all columns in one pass.

    A sketch of 2**bits buckets a column is all that moves. Nulls are no values.
    """
    estimates = [F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(bits))).alias(f"d{i}") for i, c in enumerate(columns)]
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(columns)]
    return df.agg(*estimates).select(F.inline(F.array(*entries)))


def heavy_labels(df: DataFrame, columns: Sequence[str], share: float) -> DataFrame:
    """(column, value, rows): every value, null included, that at least ``share`` of all rows hold, with its exact count.

    The first pass keeps a summary of ``2 / share`` values for each column and task, which misses the count of a value by a known
    amount at most. Summaries add up, and so do their errors; at most ``2 / share`` values of a column can reach
    the share by the sum of both. The second pass counts these exactly. So what is moved does not grow with the number of
    different values. An empty table has no such values.
    """
    if not 0 < share <= 1:
        raise ValueError(f"the share must be above 0 and at most 1, not {share}")
    columns, size = list(columns), math.ceil(2 / share)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, missed, seen = [pd.Series(dtype="int64") for _ in columns], [0] * len(columns), 0
        for batch in batches:
            seen += len(batch)
            for i in range(len(columns)):
                kept[i], error = _fewest(kept[i], batch[f"c{i}"].value_counts(dropna=False), size)
                missed[i] += error
        for i, counts in enumerate(kept):
            # The row without a value carries the rows and the error of the task.
            yield pd.DataFrame({"at": [i], "held": [False], "value": [None], "low": [missed[i]], "seen": [seen]})
            values = [None if pd.isna(v) else v for v in counts.index]
            yield pd.DataFrame({"at": i, "held": True, "value": pd.Series(values, dtype=object), "low": counts.to_numpy(), "seen": 0})

    found = texts.mapInPandas(summaries, "at int, held boolean, value string, low bigint, seen bigint")
    sums = written(found.groupBy("at", "held", "value").agg(F.sum("low").alias("low"), F.sum("seen").alias("seen")), "heavy")
    totals = sums.where("NOT held").select("at", F.col("low").alias("missed"), F.col("seen").alias("total"))
    likely = sums.where("held").drop("seen").join(totals, "at").where(F.col("low") + F.col("missed") >= F.col("total") * share)
    likely = written(likely.select("at", "value", "total"), "heavy")
    cells = F.array(*[F.struct(F.lit(i).alias("_at"), F.col(f"c{i}").alias("_value")) for i in range(len(columns))])
    each = texts.select(F.inline(cells))
    # The candidates are few and of known size, so they are broadcast and the table stays where it is.
    same = (F.col("_at") == F.col("at")) & F.col("_value").eqNullSafe(F.col("value"))
    counted = each.join(likely, same).groupBy("at", "value", "total").agg(F.count(F.lit(1)).alias("rows"))
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("at") + 1)
    return counted.where(F.col("rows") >= F.col("total") * share).select(name.alias("column"), "value", "rows")


def _fewest(kept: pd.Series, more: pd.Series, size: int) -> tuple[pd.Series, int]:
    """Both counts together, cut down to ``size`` values, and by how much the count of any value is now too small at most.

    All counts are lowered by the largest of those that are left out, so an error costs ``size`` values as many rows.
    """
    both = pd.concat([kept, more]).groupby(level=0, dropna=False, sort=False).sum()
    if len(both) <= size:
        return both, 0
    both = both.sort_values(ascending=False)
    cut = int(both.iloc[size])
    both = both.iloc[:size] - cut
    return both[both > 0], cut
