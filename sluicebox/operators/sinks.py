"""Writing and changing tables. A change takes the old version of a table and returns the new one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.operators.skew import flag_keys, present
from sluicebox.scratch import written


def write_csv(df: DataFrame, path: str, delimiter: str = ",", encoding: str = "utf-8", mode: str = "overwrite") -> None:
    """A folder of CSV files with a header line, quotes doubled. An empty text is read back as null."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def append_jdbc(df: DataFrame, url: str, table: str, connection: Mapping[str, str] | None = None) -> None:
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, **dict(connection or {})).save()


def constants_for_match(df: DataFrame, condition: Column, key: str, constants: Mapping[str, object], limit: int = 1) -> DataFrame:
    """Constant columns next to the key of the matching rows, ``limit`` of them."""
    return df.where(condition).select(key, *[F.lit(v).alias(c) for c, v in constants.items()]).limit(limit)


def absent_rows(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key is not in ``existing``, one per key; null keys never conflict.

    Of several new rows with one key the smallest stays, so that the choice does not depend on the run.
    """
    keys = list(keys)
    rest = [c for c in new.columns if c not in keys]
    complete = new.where(present(keys))
    one = complete.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else complete.distinct()
    picked = one.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in new.columns])
    fresh = _without_match(written(picked, "new"), existing, keys)
    return fresh.select(*new.columns).unionByName(new.where(~present(keys)))


def _without_match(changes: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``changes``, written down and each key once, whose key is not in ``target``.

    The target's keys are first cut down to those of the changes. Their size is known, so Spark broadcasts few of them and moves
    nothing of the target; beyond its threshold both sides are shuffled.
    """
    known = target.select(*keys).join(changes.select(*keys), list(keys), "left_semi").distinct()
    return changes.join(known, list(keys), "left_anti")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new version of a table: what it had, and the new rows whose key it did not have."""
    return existing.unionByName(absent_rows(existing, new, keys), allowMissingColumns=True)


def upsert(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], now: dt.datetime | Column | None = None,
    stamp: str | None = "updated_at", insert: bool = True,
) -> DataFrame:
    """Overwrite the columns of ``changes`` on matching rows and set ``stamp`` on them.

    A null in ``changes`` is written as a null. Rows without a match are added unless ``insert`` is off; a null key
    matches nothing. A key that occurs twice in ``changes`` is an error, raised at once.
    """
    keys = list(keys)
    fields = [c for c in changes.columns if c not in keys]
    # Written down, so that Spark knows its size: few changes are broadcast, and the target is not shuffled.
    once = changes.where(present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), F.first(F.struct(*fields, *keys)).alias("_new"))
    twice = F.raise_error(F.lit("a key occurs twice in the changes")).cast("boolean")
    checked = written(once.withColumn("_changed", F.when(F.col("_times") > 1, twice).otherwise(F.lit(True))).drop("_times"), "changes")
    joined = target.join(checked, keys, "left")
    moment = _moment(now, target, stamp)
    out = []
    for c in target.columns:
        if c in keys:
            value = F.col(c)
        elif c == stamp:
            value = F.when(F.col("_changed"), moment).otherwise(F.col(c))
        elif c in fields:
            value = F.when(F.col("_changed"), F.col(f"_new.{c}")).otherwise(F.col(c))
        else:
            value = F.col(c)
        out.append(value.alias(c))
    changed = joined.select(*out)
    if not insert:
        return changed
    fresh = _without_match(checked, target, keys).where("_changed").select(*keys, *[F.col(f"_new.{c}").alias(c) for c in fields])
    unmatched = fresh.unionByName(changes.where(~present(keys)))
    added = [
        moment.alias(c) if c == stamp else F.col(c).cast(f.dataType).alias(c) if c in changes.columns else F.lit(None).cast(f.dataType).alias(c)
        for c, f in zip(target.columns, target.schema.fields, strict=True)
    ]
    return changed.unionByName(unmatched.select(*added))


def _moment(now: dt.datetime | Column | None, target: DataFrame, stamp: str | None) -> Column:
    moment = now if isinstance(now, Column) else F.current_timestamp() if now is None else F.lit(now.isoformat(sep=" "))
    return moment.cast(target.schema[stamp].dataType) if stamp in target.columns else moment


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` points to ``parent.key``; ``on_delete`` is ``cascade`` or ``set_null``."""

    child: str
    column: str
    parent: str
    key: str = "id"
    on_delete: str = "cascade"


def delete(
    tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey], table: str, deleted: DataFrame, key: str = "id"
) -> dict[str, DataFrame]:
    """New versions of all tables after the rows of ``table`` with the keys of ``deleted`` are gone.

    Children are deleted or lose their key as their foreign key says, and so on down to their own children.
    """
    out = dict(tables)
    _delete(out, foreign_keys, table, deleted.select(key).distinct(), key, tables[table])
    return out


def _delete(
    tables: dict[str, DataFrame], foreign_keys: Sequence[ForeignKey], table: str, gone: DataFrame, key: str, before: DataFrame
) -> None:
    """Remove the rows of ``table`` whose ``key`` is in ``gone``; ``before``: the table that still has them.

    Each table is read once for its own rows, and once more if rows of it take others with them. Frequent keys of a
    table are split by adaptive execution, as the other side of each join has each key once.
    """
    tables[table] = tables[table].join(gone, key, "left_anti").select(*tables[table].columns)
    for fk in foreign_keys:
        if fk.parent != table or fk.child not in tables:
            continue
        child = tables[fk.child]
        keys = gone if fk.key == key else before.join(gone, key, "left_semi").select(fk.key).where(present([fk.key])).distinct()
        orphans = keys.select(F.col(fk.key).alias(fk.column))
        if fk.on_delete == "set_null":
            flagged = flag_keys(child, orphans, [fk.column], "_orphan")
            cleared = F.when(~F.col("_orphan"), F.col(fk.column)).alias(fk.column)
            tables[fk.child] = flagged.select(*[cleared if c == fk.column else F.col(c) for c in child.columns])
        else:
            _delete(tables, foreign_keys, fk.child, orphans, fk.column, child)


def with_defaults(df: DataFrame, schema: T.StructType, defaults: Mapping[str, Column]) -> DataFrame:
    """All columns of ``schema``: absent ones get their default, or null. Nulls that are present stay."""
    absent = lambda f: defaults.get(f.name, F.lit(None)).cast(f.dataType)
    return df.select(*[F.col(f.name) if f.name in df.columns else absent(f).alias(f.name) for f in schema.fields])


def bag_union(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables, repetitions included; an empty table keeps its columns."""
    if not tables:
        raise ValueError("nothing to union")
    return reduce(DataFrame.unionByName, tables)
