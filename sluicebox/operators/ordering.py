"""Row numbers, pages and exact percentiles over a total order, without collecting the order in one task.

The table is range-partitioned and sorted once and written to the shared folder with each row's partition and
position. Everything after that only adds per-partition offsets, one small row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.scratch import written

POSITION_BITS = 33  # of a monotonically increasing id


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` in range partitions of ``order``, with ``_part`` and ``_pos``, written down.

    Rows that tie on ``order`` are spread by the hash of the whole row and then by their place in the input, so a
    frequent order key or many copies of one row do not have to share a partition.
    """
    hashable = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in hashable])).withColumn(
        "_place", F.monotonically_increasing_id()
    )
    by = [*order, "_tie", "_place"]
    placed = (
        tied.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_tie", "_place")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return written(
        placed.select(
            *df.columns,
            F.shiftright("_id", POSITION_BITS).cast("int").alias("_part"),
            (F.col("_id") % F.lit(2**POSITION_BITS)).alias("_pos"),
        ),
        "ranged",
    )


def _offsets(sizes: DataFrame, size: str) -> DataFrame:
    """Running total before each partition; one row per shuffle partition, so the ordered window is small."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_before"))


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """``df`` with a dense row number from 0, in ascending ``order``."""
    placed = _ranged(df, order)
    offsets = _offsets(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_n")
    indexed = placed.join(F.broadcast(offsets), "_part")
    return indexed.select(*df.columns, (F.col("_before") + F.col("_pos")).alias(name))


def pages(df: DataFrame, order: Sequence[str], page_size: int = 10_000, name: str = "page_id") -> DataFrame:
    """``df`` with the number of the page of ``page_size`` rows that holds the row; the last page may be short."""
    indexed = row_index(df, order, "_index")
    return indexed.withColumn(name, F.floor(F.col("_index") / F.lit(page_size)).cast("bigint")).drop("_index")


def page(df: DataFrame, order: Sequence[str | Column], page_size: int, number: int) -> DataFrame:
    """One page: ``LIMIT page_size OFFSET number * page_size`` after a total order, in that order.

    The rows are put into ranges of the order and written down; the ranges' sizes say which of them hold the page, and
    only these are read. No task holds more than a range, however far back the page is.
    """
    if page_size <= 0:
        return df.limit(0)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    place = F.monotonically_increasing_id()
    ranged = df.withColumn("_id", place).repartitionByRange(*columns, "_id").sortWithinPartitions(*columns, "_id")
    numbered = ranged.withColumn("_id", place)
    rows = written(numbered.select(
        *[F.col(f"`{c}`") for c in df.columns], F.shiftright("_id", POSITION_BITS).cast("int").alias("_part"),
        (F.col("_id") % F.lit(2**POSITION_BITS)).alias("_pos"),
    ), "page")
    first, end = number * page_size, (number + 1) * page_size
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    held = _offsets(sizes, "_n").join(sizes, "_part").where((F.col("_before") < F.lit(end)) & (F.col("_before") + F.col("_n") > F.lit(first)))
    indexed = rows.join(F.broadcast(held.drop("_n")), "_part").withColumn("_index", F.col("_before") + F.col("_pos"))
    inside = indexed.where((F.col("_index") >= F.lit(first)) & (F.col("_index") < F.lit(end)))
    return inside.orderBy("_index").select(*[F.col(f"`{c}`") for c in df.columns])


def percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation: one row per group with ``samples``, ``mean`` and a column per point.

    Equal values are counted before they are ordered, in one scan of ``df``, and a group may span any number of ranges.
    The rows of each group in each range give its place in the order; only ranges that hold a wanted place are read again.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(group).alias("_group"), F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    placed = _ranged(counted, ["_group", "_value"])
    # Sums of six decimals are exact whatever their order; what is smaller, or too large, is summed as it is.
    exact = F.col("_value").try_cast("decimal(20,6)")
    rest = F.col("_value") - F.coalesce(exact.cast("double"), F.lit(0.0))
    totals = placed.groupBy("_group", "_part").agg(
        F.sum("_rows").alias("_n"), F.coalesce(F.sum(exact * F.col("_rows").cast("decimal(17,0)")), F.lit(0)).alias("_exact"),
        F.sum(rest * F.col("_rows")).alias("_rest"),
    )
    spans = Window.partitionBy("_group")
    earlier = spans.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = totals.select(
        "_group", "_part", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(spans).alias("samples"), ((F.sum("_exact").over(spans).cast("double") + F.sum("_rest").over(spans)) / F.sum("_n").over(spans)).alias("mean"),
    )
    at = {name: (F.col("samples") - 1) * F.lit(float(p)) for name, p in points.items()}
    ends = {f"{n}_{end}": f(x) for n, x in at.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    hit = reduce(lambda a, b: a | b, [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_n")) for r in ends.values()])
    held = known.where(hit).select(F.col("_group").alias("_of"), F.col("_part").alias("_at"), "_before", "samples", "mean")
    same = F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at"))
    within = Window.partitionBy("_of", "_at").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_before") + F.coalesce(F.sum("_rows").over(within), F.lit(0))
    rows = placed.join(held, same).withColumn("_start", place)
    found = [
        F.max(F.when((F.col("_start") <= r) & (r < F.col("_start") + F.col("_rows")), F.col("_value"))).alias(n)
        for n, r in ends.items()
    ]
    each = rows.groupBy("_of").agg(F.first("samples").alias("samples"), F.first("mean").alias("mean"), *found)
    between = {
        n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (x - F.floor(x)) for n, x in at.items()
    }
    return each.select(F.col("_of").alias(group), "samples", "mean", *[column.alias(name) for name, column in between.items()])
