"""Bounds of pages with equal numbers of rows, on keys of any distribution.

Ranges of equal width give empty and huge pages where keys are sparse or skewed. Here the places of the bounds are found by counting: keys are
counted in at most 2**``STEP`` ranges of equal width, then only ranges that hold a page's first row are counted again, ``STEP`` bits
finer each time, until a range is one key (four passes for any 64-bit key, one for keys that span less than 65,536). Counts are made inside each
task first, so no rows are shuffled or sorted, and a hot key is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.functions.scalars import col_of
from sluicebox.operators.ordering import row_index
from sluicebox.scratch import written

STEP = 16


def page_bounds(df: DataFrame, key: str | Column, page_size: int) -> DataFrame:
    """One row per page in order of an integer key: page_id, low, high, first_row, n_rows.

    A page holds the keys from ``low`` up to, not including, ``high`` (null for the last page). Rows of one key stay together: a
    page ends after the key that holds its last row, and a key of more than a page's rows is no reason for empty pages. With different
    keys every page but the last has exactly ``page_size`` rows. Rows without a key are on no page. An empty table has no pages.
    The input must give the same rows each time it is read.
    """
    if page_size <= 0:
        raise ValueError(f"a page has at least one row: {page_size}")
    keys = df.select(col_of(key).cast("bigint").alias("_key")).where(F.col("_key").isNotNull())
    low, high, total = keys.agg(F.min("_key"), F.max("_key"), F.count(F.lit(1))).first()
    low, high = (0, 0) if low is None else (low, high)
    before, n = F.col("_before"), F.col("_n")
    shift = max(0, (high - low).bit_length() - STEP)

    def place(bits: int) -> Column:
        """Number of the range of 2**bits keys that holds a key, counted on the grid of all keys."""
        return F.shiftright(F.col("_key"), bits)

    held, coarse = None, 0
    while True:
        if held is None:
            counted = keys.groupBy(place(shift).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
            counted = counted.withColumn("_base", F.lit(0).cast("bigint"))
            within = Window.orderBy("_at")  # 2**STEP + 1 rows at most
        else:
            inside = keys.withColumn("_up", place(coarse)).join(held, "_up")
            counted = inside.groupBy("_up", place(shift).alias("_at")).agg(F.count(F.lit(1)).alias("_n"), F.first("_base").alias("_base"))
            within = Window.partitionBy("_up").orderBy("_at")  # 2**STEP rows at most
        earlier = F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.select("_at", "_n", (F.col("_base") + earlier).alias("_before"))
        # The first place of a page at or after the range's first row, and whether the range holds it.
        opening = F.expr(f"(_before + {page_size - 1}L) div {page_size}L * {page_size}L")
        holds = placed.where(opening < before + n)
        if shift == 0:
            break
        held = written(holds.select(F.col("_at").alias("_up"), before.alias("_base")), "page-bounds")
        coarse, shift = shift, max(0, shift - STEP)
    # A page that opens within the rows of a key starts with the next key; where that key's first row opens it as well, its number is known.
    own = F.when(before % page_size == 0, F.struct(F.col("_at").alias("low"), before.alias("first_row")))
    inner = F.expr(f"_before div {page_size}L * {page_size}L + {page_size}L")
    following = F.when(inner < before + n, F.struct((F.col("_at") + 1).alias("low"), (before + n).alias("first_row")))
    opened = holds.select(F.explode(F.array_compact(F.array(own, following))).alias("s")).select("s.low", "s.first_row")
    starts = opened.where(F.col("first_row") < F.lit(total)).groupBy("first_row").agg(F.max("low").alias("low"))
    numbered = written(row_index(starts, ["low"], "page_id"), "page-starts")
    after = numbered.select((F.col("page_id") - 1).alias("page_id"), F.col("low").alias("high"), F.col("first_row").alias("_end"))
    return numbered.join(after, "page_id", "left").select(
        "page_id", "low", "high", "first_row", (F.coalesce("_end", F.lit(total)) - F.col("first_row")).alias("n_rows"))


def page_conditions(bounds: DataFrame, key: str) -> list[str]:
    """One SQL condition a page, for scans that take a list of predicates; together they hold for every row once.

    The list lies in the driver, one text for each task of the scan. ``key`` is the key as the source spells it; rows without one are on the first page.
    """
    found = []
    pages = bounds.select("low", "high").orderBy("low").collect()
    for i, (low, high) in enumerate(pages):
        parts = ([f"{key} >= {low}"] if i else []) + ([f"{key} < {high}"] if high is not None else [])
        text = " AND ".join(parts) or "1 = 1"
        found.append(f"({text}) OR {key} IS NULL" if i == 0 else text)
    return found
