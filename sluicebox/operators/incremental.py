"""Rule results kept by file, so that after a change only new and changed files are evaluated.

A store has three tables. ``files``: which version of which file was evaluated, in which run and for which rules. ``counts``: rows and
violations of the row rules by file. ``keys``: the rows of each key of the set rules by file. All of them add up: a result is put
together from the files that the folder has now, so what is kept of replaced and removed files is no longer counted. A run writes ``files`` last;
what a lost run left in the other tables belongs to no file, and the next run evaluates its files again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators.rules import RowRule, Rule, any_broken, named_once, row_rules, set_rules
from sluicebox.scratch import written
from sluicebox.streaming.keys import counted_rules, failing_keys, parent_keys, tagged_keys

FILES = "file string, size bigint, modified timestamp, rules string, run string"
COUNTS = "file string, rule_name string, failed_count bigint, records bigint, run string"
KEYS = "file string, rule_name string, key string, rows bigint, run string"


@dataclass(frozen=True)
class Checked:
    """The state of the whole table, and how many files it has and how many of them were read.

    ``results``: (rule_name, rule_type, failed_count). ``counters``: (records_processed, records_failed); a failed record breaks
    at least one row rule.
    """

    results: DataFrame
    counters: DataFrame
    files: int
    files_read: int


def rules_digest(rules: Sequence[Rule]) -> str:
    """Tells one set of rules from another: results of other rules are not used again.

    Parents of ``references`` are no part of it, as they are joined each time.
    """
    lines = [f"{r.name}|{r.kind}|{r.columns}|{r.violation if isinstance(r, RowRule) else ''}" for r in rules]
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def check_changed(
    spark: SparkSession, folder: str, rules: Sequence[Rule], store: str,
    read: Callable[[list[str]], DataFrame] | None = None,
) -> Checked:
    """The results of ``rules`` over the files below ``folder``, reading only those that ``store`` does not know yet.

    A file is known by path, size and time. ``read`` makes a table of paths (Parquet files by default); it must be a plain scan, in
    which Spark can tell the file of a row. Only paths of files to read come to the driver, as any scan has them there.
    """
    named_once(rules)
    read = read or (lambda paths: spark.read.option("basePath", folder).parquet(*paths))
    digest = rules_digest(rules)
    run = uuid.uuid4().hex
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # The listing is written down once, so that all steps see the same versions.
    now = written(
        listing.select(
            "path",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
        ),
        "listing",
    )
    version = ["file", "size", "modified"]
    known = _stored(spark, f"{store}/files", FILES).where(F.col("rules") == digest)
    _stored(spark, f"{store}/counts", COUNTS)
    _stored(spark, f"{store}/keys", KEYS)
    fresh = now.join(known, version, "left_anti")
    paths = sorted(r["path"] for r in fresh.select("path").collect())
    if paths:
        rows = read(paths)
        _evaluate(rows, rules, store, run)
        done = fresh.select(*version, F.lit(digest).alias("rules"), F.lit(run).alias("run"))
        written(done, "fresh").write.mode("append").parquet(f"{store}/files")
    current = _current(spark, now, digest, store)
    counts = _stored(spark, f"{store}/counts", COUNTS).join(current, ["file", "run"], "left_semi")
    counters = counts.where(F.col("rule_name") == "").agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records_processed"),
        F.coalesce(F.sum("failed_count"), F.lit(0)).alias("records_failed"),
    )
    return Checked(_results(spark, now, current, counts, rules, store, read), counters, now.count(), len(paths))


def _evaluate(rows: DataFrame, rules: Sequence[Rule], store: str, run: str) -> None:
    """Append what the rules find in each file: one aggregation for the row rules, one for all keys."""
    tagged = rows.withColumn("_file", F.col("_metadata.file_path"))
    fused = row_rules(rules)
    counts = tagged.groupBy(F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(any_broken(fused)).alias("failed"),
        *[F.count_if(r.broken()).alias(f"f{i}") for i, r in enumerate(fused)],
    )
    # The run's own counters stand under an empty name.
    named = [("", "failed"), *[(r.name, f"f{i}") for i, r in enumerate(fused)]]
    entries = [F.struct(F.lit(n).alias("rule_name"), F.col(c).alias("failed_count")) for n, c in named]
    per_rule = counts.select("file", F.inline(F.array(*entries)), "records").withColumn("run", F.lit(run))
    per_rule.write.mode("append").parquet(f"{store}/counts")
    sets = set_rules(rules)
    if sets:
        keys = tagged_keys(tagged, sets, "_file").groupBy(F.col("_file").alias("file"), "rule_name", "key")
        keys.agg(F.count(F.lit(1)).alias("rows")).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{store}/keys")


def _current(spark: SparkSession, now: DataFrame, digest: str, store: str) -> DataFrame:
    """(file, run): the run that evaluated the present version of each file; of two that did so at the same time, one."""
    known = _stored(spark, f"{store}/files", FILES).where(F.col("rules") == digest)
    return now.join(known, ["file", "size", "modified"]).groupBy("file").agg(F.max("run").alias("run"))


def _results(
    spark: SparkSession, now: DataFrame, current: DataFrame, counts: DataFrame, rules: Sequence[Rule], store: str,
    read: Callable[[list[str]], DataFrame],
) -> DataFrame:
    names = spark.createDataFrame([(r.name, r.kind) for r in row_rules(rules)], "rule_name string, rule_type string")
    sums = counts.groupBy("rule_name").agg(F.sum("failed_count").alias("failed_count"))
    out = names.join(sums, "rule_name", "left").select(
        "rule_name", "rule_type", F.coalesce("failed_count", F.lit(0)).cast("bigint").alias("failed_count")
    )
    sets = set_rules(rules)
    if not sets:
        return out
    keys = _stored(spark, f"{store}/keys", KEYS).join(current, ["file", "run"], "left_semi")
    total = keys.groupBy("rule_name", "key").agg(F.sum("rows").alias("rows"))
    one = now.select("path").first()
    schema = read([one["path"]]).schema if one else None
    parents = parent_keys(spark, schema, sets) if schema else spark.createDataFrame([], "rule_name string, key string")
    return out.unionByName(counted_rules(spark, failing_keys(total, parents, sets), sets))
