"""Rows with JSON labels, stored beside an inverted index from (path, value) to the parts that hold it.

Rows are dealt to parts, one folder each, by the hash of their labels, so rows with equal labels lie together and a value is in no more
parts than there are different label documents with it. The index has one row for each path, value and part, counted inside each task first, so a
value of a third of all rows is at most as many index rows as there are parts. A search reads one bucket of the index and lets Spark
prune the folders of all other parts before the scan; no list of parts passes through the driver's code.

A path is the keys down to a value, joined by dots, ``DEPTH`` levels deep; what lies deeper, and arrays, are their JSON text. Strings count
without quotes, so "42" and 42 are one value. Rows without labels, with malformed ones or JSON null are stored and not indexed. Of equal keys in
one object all count. Values over ``LONGEST`` characters are indexed by their SHA-256.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions.scalars import col_of

DEPTH = 3
BUCKETS = 32
LONGEST = 256
#: A search broadcasts the numbers of the parts that hold its labels: 16 bytes each and no more than there are parts of all batches.
MOST_PARTS = 100_000
INDEX_SCHEMA = "path string, value string, _part int, records bigint, _batch string, _bucket int"


def label_entries(labels: str | Column) -> Column:
    """The labels of a row as an array of (path, value); null without labels."""

    def parsed(text: Column) -> Column:
        return F.map_entries(F.from_json(text, "map<string,string>"))

    def pair(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"))

    level = parsed(col_of(labels))
    levels = [F.transform(level, lambda e: pair(e["key"], e["value"]))]
    for _ in range(DEPTH - 1):
        objects = F.filter(levels[-1], lambda e: F.ltrim(e["value"]).startswith("{"))
        inner = F.transform(objects, lambda e: F.transform(
            F.coalesce(parsed(e["value"]), F.array()), lambda f: pair(F.concat_ws(".", e["path"], f["key"]), f["value"])))
        levels.append(F.flatten(inner))
    return F.filter(F.concat(*levels), lambda e: e["value"].isNotNull())


def _short(value: Column) -> Column:
    return F.when(F.length(value) > LONGEST, F.sha2(value, 256)).otherwise(value)


def _bucket(path: Column, value: Column) -> Column:
    return F.pmod(F.xxhash64(path, value), F.lit(BUCKETS)).cast("int")


def write_indexed(df: DataFrame, path: str, labels: str, batch: str, parts: int = 64) -> None:
    """Store ``df`` as one batch with its index. A batch written again replaces itself; other batches stay."""
    if not re.fullmatch(r"\w+", batch):
        raise ValueError(f"a batch is named by letters, digits and underscores: {batch!r}")
    if not 0 < parts <= MOST_PARTS:
        raise ValueError(f"between 1 and {MOST_PARTS} parts a batch: {parts}")
    spark = df.sparkSession
    rows, index = f"{path}/rows/_batch=b_{batch}", f"{path}/index/_batch=b_{batch}"
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(col_of(labels)), F.lit(parts)).cast("int"))
    dealt.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(rows)
    stored = spark.read.schema(dealt.schema).parquet(rows)
    found = stored.select("_part", F.explode(F.array_distinct(label_entries(labels))).alias("e")).select(
        F.col("e.path").alias("path"), _short(F.col("e.value")).alias("value"), "_part")
    counted = found.groupBy("path", "value", "_part").agg(F.count(F.lit(1)).alias("records"))
    bucketed = counted.withColumn("_bucket", _bucket(F.col("path"), F.col("value"))).hint("rebalance", "_bucket")
    (
        bucketed.sortWithinPartitions("_bucket", "path", "value").write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#value", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.page.row.count.limit", 1000).partitionBy("_bucket").parquet(index)
    )


def _postings(spark: SparkSession, path: str, wanted: Mapping[str, object]) -> DataFrame:
    index = spark.read.schema(INDEX_SCHEMA).option("basePath", f"{path}/index").parquet(f"{path}/index")
    condition = F.lit(False)
    for name, value in wanted.items():
        p, v = F.lit(name), _short(F.lit(str(value)))
        condition = condition | ((F.col("_bucket") == _bucket(p, v)) & (F.col("path") == p) & (F.col("value") == v))
    return index.where(condition)


def label_counts(spark: SparkSession, path: str, wanted: Mapping[str, object]) -> DataFrame:
    """How many stored rows hold each of the wanted labels, from the index alone: path, value, records."""
    return _postings(spark, path, wanted).groupBy("path", "value").agg(F.sum("records").alias("records"))


def find_labelled(spark: SparkSession, path: str, labels: str, wanted: Mapping[str, object]) -> DataFrame:
    """The stored rows that hold all wanted labels (path to value); only parts that hold each of them are read."""
    if not wanted:
        raise ValueError("no labels to look for")
    holding = _postings(spark, path, wanted).groupBy("_batch", "_part").agg(F.count(F.lit(1)).alias("_held"))
    parts = holding.where(F.col("_held") == len(wanted)).select("_batch", "_part")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    names = [c for c in rows.columns if c not in ("_batch", "_part")]
    entries = label_entries(labels)
    for name, value in wanted.items():
        rows = rows.where(F.array_contains(entries, F.struct(F.lit(name).alias("path"), F.lit(str(value)).alias("value"))))
    return rows.join(F.broadcast(parts), ["_batch", "_part"], "left_semi").select(*[F.col(f"`{c}`") for c in names])
