"""Rules that compare rows of different pieces of a folder: ``unique`` and ``references`` over a stream.

The keys of all rules are counted by one stateful aggregation. Its state is kept by Spark in buckets of keys and by batch number, so a
repeated batch starts from the state before it and counts once. Keys are counted inside each task first: a frequent key
moves as one row. The state grows with the number of different keys, so it is kept on the executors' disks. Every bucket
is opened and saved once a piece, whatever the piece brings: there are as many as the cluster's cores can use, not one a shuffle partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.draws import key_text
from sluicebox.operators.rules import ReferenceRule, SetRule, named_once
from sluicebox.operators.skew import present
from sluicebox.scratch import written
from sluicebox.streaming.folders import each_piece

KEY_ROWS = "rule_name string, key string, rows bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
_STATES = "org.apache.spark.sql.execution.streaming.state."
BUCKETS_PER_CORE = 2


def state_settings(spark: SparkSession) -> dict[str, str]:
    """How the state of the keys is kept: on disk, unless the session names another provider than Spark's own, in few buckets."""
    buckets = min(int(spark.conf.get(PARTITIONS)), BUCKETS_PER_CORE * spark.sparkContext.defaultParallelism)
    settings = {PARTITIONS: str(buckets)}
    if spark.conf.get(PROVIDER).endswith(".HDFSBackedStateStoreProvider"):
        settings[PROVIDER] = _STATES + "RocksDBStateStoreProvider"
        # A piece saves what it changed, the memory of all buckets of an executor has one bound, and keys are not looked up to be counted.
        rocksdb = {"changelogCheckpointing.enabled": "true", "boundedMemoryUsage": "true", "trackTotalNumberOfRows": "false"}
        settings |= {f"spark.sql.streaming.stateStore.rocksdb.{name}": value for name, value in rocksdb.items()}
    return settings


def _text(columns: Sequence[str | Column], types: Sequence[T.DataType]) -> Column:
    """The text of a key in the given types; both zeros of a floating type are one key."""
    parts = []
    for c, dtype in zip(columns, types, strict=True):
        value = (F.col(c) if isinstance(c, str) else c).cast(dtype)
        parts.append(value + F.lit(0).cast(dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else value)
    return key_text(parts)


def tagged_keys(df: DataFrame, rules: Sequence[SetRule], *keep: str) -> DataFrame:
    """(rule_name, key) and the columns to ``keep``: the key of each row for each rule; keys with a null are left out."""
    entries = []
    for r in rules:
        text = _text(r.columns, [df.schema[c].dataType for c in r.columns])
        entries.append(F.when(present(r.columns), F.struct(F.lit(r.name).alias("rule_name"), text.alias("key"))))
    return df.select(*keep, F.explode(F.array_compact(F.array(*entries))).alias("entry")).select(*keep, "entry.*")


def parent_keys(spark: SparkSession, schema: T.StructType, rules: Sequence[SetRule]) -> DataFrame:
    """(rule_name, key): the keys that the ``references`` rules allow, each once, as text in the child's types."""
    parts = [spark.createDataFrame([], "rule_name string, key string")]
    for r in rules:
        if isinstance(r, ReferenceRule):
            text = _text(r.parent_columns, [schema[c].dataType for c in r.columns])
            parts.append(r.parent.where(present(r.parent_columns)).select(F.lit(r.name).alias("rule_name"), text.alias("key")))
    return reduce(DataFrame.unionByName, parts).distinct()


def failing_keys(counts: DataFrame, parents: DataFrame, rules: Sequence[SetRule]) -> DataFrame:
    """The rows of ``counts`` (rule_name, key, rows) that break their rule: repeated keys, or keys without a parent."""
    missing_counts = [r.name for r in rules if isinstance(r, ReferenceRule)]
    # Keys of the unique rules have no parents, so they all pass the join.
    left = counts.join(parents, ["rule_name", "key"], "left_anti")
    return left.where(F.col("rule_name").isin(missing_counts) | (F.col("rows") > 1))


def counted_rules(spark: SparkSession, failing: DataFrame, rules: Sequence[SetRule]) -> DataFrame:
    """(rule_name, rule_type, failed_count) of ``failing``, whose keys occur once a rule; rules that hold have 0."""
    names = spark.createDataFrame([(r.name, r.kind) for r in rules], "rule_name string, rule_type string")
    counts = failing.groupBy("rule_name").agg(F.sum("rows").alias("failed_count"))
    return names.join(counts, "rule_name", "left").select(
        "rule_name", "rule_type", F.coalesce("failed_count", F.lit(0)).cast("bigint").alias("failed_count")
    )


def check_folder_keys(
    spark: SparkSession, folder: str, schema: T.StructType | str, rules: Sequence[SetRule], out: str, checkpoint: str,
    **read: object,
) -> DataFrame:
    """Check set rules over all pieces of a folder together; the result has the columns of ``failed_counts``.

    ``out`` gets, by piece, the keys that break a rule with their rows so far, those of earlier pieces included, so
    ``out`` also tells in which piece a key first failed. A restarted run goes on with the counts of the pieces before it.
    ``settings`` among ``read`` replaces ``state_settings``.
    """
    named_once(rules)
    empty = spark.createDataFrame([], schema)
    parents = written(parent_keys(spark, empty.schema, rules), "parents")

    def count(stream: DataFrame) -> DataFrame:
        return tagged_keys(stream, rules).groupBy("rule_name", "key").agg(F.count(F.lit(1)).alias("rows"))

    def handle(counts: DataFrame, number: int) -> None:
        failing_keys(counts, parents, rules).write.mode("overwrite").parquet(f"{out}/piece={number}")

    # So that a folder without files has a result as well.
    spark.createDataFrame([], KEY_ROWS).write.mode("ignore").parquet(f"{out}/piece=-1")
    read = {"settings": state_settings(spark), **read}
    each_piece(spark, folder, empty.schema, handle, checkpoint, shape=count, output_mode="update", **read)
    found = spark.read.schema(KEY_ROWS + ", piece int").parquet(out)
    # Counts of a key only grow, so the largest is the last.
    last = found.groupBy("rule_name", "key").agg(F.max("rows").alias("rows"))
    return counted_rules(spark, last, rules)
