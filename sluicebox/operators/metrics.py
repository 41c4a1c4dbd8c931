"""Metric rows, latency rollups and run throughput."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.scalars import col_of
from sluicebox.operators.latest import latest_per
from sluicebox.operators.ordering import percentiles

LATENCY_POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SKETCH_SIZE = 800


def latency_rollup(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows, mean and exact 50th, 95th and 99th percentile of ``value`` per group."""
    return percentiles(df, group, value, LATENCY_POINTS)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest sample of every metric; equal times are decided by the id."""
    return latest_per(metrics, ["metric_name"], ["timestamp", "id"])


def throughput(records: str | Column, seconds: str | Column) -> Column:
    """Records per second; null when no time passed."""
    return col_of(records).cast("double") / F.nullif(col_of(seconds), F.lit(0.0))


def run_metrics(records: str | Column, seconds: str | Column) -> Column:
    """The metrics document of a run."""
    return F.to_json(
        F.struct(col_of(seconds).alias("duration_seconds"), F.round(throughput(records, seconds), 2).alias("throughput"))
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows, partitioned by day so that time filters skip whole folders.

    The rows of a day are brought together before they are written; a large day is split again by size.
    """
    days = metrics.withColumn("metric_date", F.to_date("timestamp"))
    days.hint("rebalance", "metric_date").write.mode("append").partitionBy("metric_date").parquet(path)


def sketch_rank_error(size: int = SKETCH_SIZE) -> float:
    """How far the rank of a sketched percentile is off in 99 of 100 cases: 0.0035 of all samples for size 800."""
    return 2.296 / size**0.9723  # fixed values: the fit published for quantile sketches of this kind


def write_latency_sketches(
    df: DataFrame, path: str, groups: Sequence[str], value: str, time: str, size: int = SKETCH_SIZE
) -> None:
    """Append a few kilobytes for each day and group, from which any span of days is rolled up without its samples.

    The sketches are filled inside each task before they move, so a frequent group is one row a task. Nulls and NaN are no
    samples. Days that arrive in several runs have several rows; they add up.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_value", F.col(value).cast("double"))
    sketched = known.groupBy(F.to_date(time).alias("sketch_date"), *groups).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("_value").alias("total"),
        F.min("_value").alias("minimum"),
        F.max("_value").alias("maximum"),
        F.kll_sketch_agg_double("_value", size).alias("sketch"),
    )
    sketched.hint("rebalance", "sketch_date").write.mode("append").partitionBy("sketch_date").parquet(path)


def sketched_latency(
    stored: DataFrame, groups: Sequence[str], points: Mapping[str, float] = LATENCY_POINTS, size: int = SKETCH_SIZE
) -> DataFrame:
    """Rows, mean, extremes and percentiles of the stored days, which may be filtered first, by some or none of their groups.

    Rows, mean and extremes are exact. A percentile is a sample whose rank is off by ``sketch_rank_error(size)``; as long as
    a group has no more samples than the sketch holds, it is exact in rank.
    """
    merged = stored.groupBy(*groups).agg(
        F.sum("samples").alias("samples"),
        (F.sum("total") / F.sum("samples")).alias("mean"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        F.kll_merge_agg_double("sketch", size).alias("sketch"),
    )
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in points.items()]
    return merged.select(*groups, "samples", "mean", "minimum", "maximum", *found)


def rank_errors(df: DataFrame, group: str, value: str, estimates: DataFrame, points: Mapping[str, float] = LATENCY_POINTS) -> DataFrame:
    """For each group, how far the rank of each estimate among the samples is from its point, as a share of all samples.

    One aggregation with a row for each group and task; ``estimates`` has one row a group.
    """
    samples = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(group, F.col(value).cast("double").alias("_v"))
    counts = samples.join(estimates.select(group, *points), group).groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("_v") < F.col(c)).alias(f"_below_{c}") for c in points],
        *[F.count_if(F.col("_v") <= F.col(c)).alias(f"_upto_{c}") for c in points],
    )
    off = [
        F.greatest(F.lit(0.0), F.col(f"_below_{c}") / F.col("_n") - p, F.lit(p) - F.col(f"_upto_{c}") / F.col("_n")).alias(c)
        for c, p in points.items()
    ]
    return counts.select(group, *off)
