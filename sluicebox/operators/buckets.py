"""Stored tables in hash buckets of their key, so that a change reads and writes only the buckets that hold changed keys.

A bucket is a folder; the name of the folder's column says how many there are. A change is computed from the old rows of its buckets
alone, written down, and then put in place of these folders by Spark's dynamic partition overwrite; all other files stay as they are. Equal
keys share a bucket, so nothing on the table's side is shuffled to find the rows that change. A table is changed by one job at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators.sinks import insert_if_absent, upsert
from sluicebox.scratch import written

_NAME = "_bucket_of_"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a key; keys are hashed as text, so that their types may differ between table and changes."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Store a table in ``buckets`` folders by its key."""
    name = f"{_NAME}{buckets}"
    placed = df.withColumn(name, _bucket(keys, buckets))
    placed.repartition(buckets, name).write.partitionBy(name).mode("overwrite").parquet(path)


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    stored = spark.read.parquet(path)
    name = next((c for c in stored.columns if c.startswith(_NAME)), None)
    if name is None:
        raise ValueError(f"no table in buckets: {path}")
    return stored, name, int(name.removeprefix(_NAME))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    stored, name, _ = _stored(spark, path)
    return stored.drop(name)


def _change(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], new_rows) -> list[int]:
    stored, name, buckets = _stored(spark, path)
    placed = written(changes.withColumn(name, _bucket(keys, buckets)), "changes")
    touched = sorted(r[0] for r in placed.select(name).distinct().collect())  # as many as there are buckets at most
    if touched:
        old = stored.where(F.col(name).isin(touched)).drop(name)
        changed = new_rows(old, placed.drop(name)).withColumn(name, _bucket(keys, buckets))
        changed = written(changed.repartition(len(touched), name), "buckets")
        changed.select(*stored.columns).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(name).parquet(path)
    return touched


def upsert_bucketed(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], **options) -> list[int]:
    """``upsert`` of a stored table; gives the buckets that were written anew."""
    return _change(spark, path, changes, keys, lambda old, new: upsert(old, new, keys, **options))


def insert_bucketed(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> list[int]:
    """``insert_if_absent`` into a stored table; gives the buckets that were written anew."""
    return _change(spark, path, new, keys, lambda old, rows: insert_if_absent(old, rows, keys))


def delete_bucketed(spark: SparkSession, path: str, gone: DataFrame, keys: Sequence[str]) -> list[int]:
    """Delete the rows of a stored table with these keys; gives the buckets that were written anew.

    A bucket of which nothing is left keeps one empty file.
    """
    stored, name, buckets = _stored(spark, path)
    placed = written(gone.select(*keys).distinct().withColumn(name, _bucket(keys, buckets)), "gone")
    touched = sorted(r[0] for r in placed.select(name).distinct().collect())
    if not touched:
        return []
    old = stored.where(F.col(name).isin(touched))
    left = written(old.join(placed.drop(name), list(keys), "left_anti").select(*stored.columns), "buckets")
    full = {r[0] for r in left.select(name).distinct().collect()}
    left.repartition(len(touched), name).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(name).parquet(path)
    for bucket in set(touched) - full:
        left.drop(name).limit(0).write.mode("overwrite").parquet(f"{path}/{name}={bucket}")
    return touched
