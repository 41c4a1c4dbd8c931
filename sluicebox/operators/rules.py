"""Declarative quality rules over a table.

Row rules hold a violation condition on one row; all of them are counted in a single aggregation over the table.
Set rules (unique, references) compare rows with other rows and pre-aggregate their keys before any shuffle.
As in an SQL CHECK, a condition that evaluates to null is not a violation.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.draws import key_text
from sluicebox.functions.scalars import null_or, sum_of, trimmed_length
from sluicebox.operators.skew import flag_keys, key_counts, present

MARK = "_violations"


@dataclass(frozen=True)
class RowRule:
    """``violation`` is true on a row that breaks the rule."""

    name: str
    kind: str
    columns: tuple[str, ...]
    violation: Column

    def broken(self) -> Column:
        return F.coalesce(self.violation, F.lit(False))


@dataclass(frozen=True)
class UniqueRule:
    """No two rows share the same values; a row with a null among them never conflicts."""

    name: str
    columns: tuple[str, ...]
    kind: str = "unique"

    def failed(self, df: DataFrame) -> DataFrame:
        """The keys that occur more than once, with their number of rows; counting starts inside each task."""
        return key_counts(df, self.columns).where(F.col("rows") > 1)

    def broken_rows(self, df: DataFrame) -> DataFrame:
        return df.join(self.failed(df).select(*self.columns), list(self.columns), "left_semi")

    def flag(self, rows: DataFrame, df: DataFrame, name: str) -> DataFrame:
        """``rows``, which come from ``df``, with a boolean column: the row breaks the rule. Only bad keys are joined."""
        return flag_keys(rows, self.failed(df), self.columns, name)


@dataclass(frozen=True)
class ReferenceRule:
    """Every non-null key exists in the parent table."""

    name: str
    columns: tuple[str, ...]
    parent: DataFrame
    parent_columns: tuple[str, ...]
    kind: str = "references"

    def failed(self, df: DataFrame) -> DataFrame:
        """The missing keys with their number of rows; a frequent key is a single row before the join."""
        return key_counts(df, self.columns).join(self._parents(), list(self.columns), "left_anti")

    def broken_rows(self, df: DataFrame) -> DataFrame:
        return df.where(present(self.columns)).join(self._parents(), list(self.columns), "left_anti")

    def flag(self, rows: DataFrame, df: DataFrame, name: str) -> DataFrame:
        found = flag_keys(rows, self._parents().distinct(), self.columns, name)
        return found.withColumn(name, present(self.columns) & ~F.col(name))

    def _parents(self) -> DataFrame:
        return self.parent.select(*[F.col(p).alias(c) for p, c in zip(self.parent_columns, self.columns)])


SetRule = UniqueRule | ReferenceRule
Rule = RowRule | UniqueRule | ReferenceRule


def not_null(column: str, name: str | None = None) -> RowRule:
    return RowRule(name or f"{column}_not_null", "not_null", (column,), F.col(column).isNull())


def unique(*columns: str, name: str | None = None) -> UniqueRule:
    return UniqueRule(name or "_".join(columns) + "_unique", columns)


def accepted_values(column: str, values: Sequence[object], name: str | None = None) -> RowRule:
    return RowRule(name or f"{column}_accepted", "accepted_values", (column,), ~F.col(column).isin(*values))


def in_range(column: str, low: object, high: object, name: str | None = None) -> RowRule:
    return RowRule(name or f"{column}_range", "range", (column,), ~F.col(column).between(low, high))


def min_value(column: str, low: object, name: str | None = None) -> RowRule:
    return RowRule(name or f"{column}_min", "min_value", (column,), F.col(column) < F.lit(low))


def ordered(first: str, then: str, name: str | None = None) -> RowRule:
    """``then`` is unknown or not before ``first``."""
    holds = null_or(then, F.col(then) >= F.col(first))
    return RowRule(name or f"{then}_after_{first}", "ordered", (first, then), ~holds)


def not_blank(column: str, name: str | None = None) -> RowRule:
    return RowRule(name or f"{column}_not_blank", "not_blank", (column,), ~(trimmed_length(column) > 0))


def not_empty(column: str, name: str | None = None) -> RowRule:
    return RowRule(name or f"{column}_not_empty", "not_empty", (column,), F.size(column) == 0)


def sum_at_most(parts: Sequence[str], total: str, name: str | None = None) -> RowRule:
    within = sum_of(list(parts)) <= F.col(total)
    return RowRule(name or f"{total}_bounds_parts", "sum_at_most", (*parts, total), ~within)


def max_length(column: str, limit: int, name: str | None = None) -> RowRule:
    return RowRule(name or f"{column}_max_length", "max_length", (column,), F.length(column) > limit)


def fits_decimal(column: str, precision: int, scale: int, name: str | None = None) -> RowRule:
    """The number has a place in the decimal type once its extra decimals are rounded."""
    violation = F.col(column).isNotNull() & F.col(column).try_cast(f"decimal({precision},{scale})").isNull()
    return RowRule(name or f"{column}_decimal", "fits_decimal", (column,), violation)


def uuid_text(column: str, name: str | None = None) -> RowRule:
    """The text has the layout of a UUID."""
    layout = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
    return RowRule(name or f"{column}_uuid", "uuid_text", (column,), ~F.col(column).rlike(layout))


def references(
    columns: str | Sequence[str], parent: DataFrame, parent_columns: str | Sequence[str], name: str | None = None
) -> ReferenceRule:
    child = (columns,) if isinstance(columns, str) else tuple(columns)
    target = (parent_columns,) if isinstance(parent_columns, str) else tuple(parent_columns)
    return ReferenceRule(name or "_".join(child) + "_references", child, parent, target)


# The rules that a configuration may name for a column, and those that need further values.
CONFIGURABLE: dict[str, Callable[..., Rule]] = {
    "not_null": not_null,
    "unique": unique,
    "not_blank": not_blank,
    "not_empty": not_empty,
    "accepted_values": accepted_values,
    "range": in_range,
    "min_value": min_value,
    "max_length": max_length,
    "ordered": ordered,
    "sum_at_most": sum_at_most,
    "fits_decimal": fits_decimal,
    "uuid_text": uuid_text,
}


def rules_from_config(
    config: str | Mapping, columns: Sequence[str], tables: Mapping[str, DataFrame] | None = None
) -> list[Rule]:
    """Rules named by a JSON configuration.

    ``{"validations": ["not_null", "unique"]}`` applies each rule to each of ``columns``. An entry may also be an
    object: ``{"rule": "range", "args": ["amount", 0, 100]}``. ``references`` names one of ``tables``:
    ``{"rule": "references", "args": ["customer_id", "customers", "id"]}``.
    """
    parsed = json.loads(config) if isinstance(config, str) else config
    rules: list[Rule] = []
    for entry in parsed.get("validations", []):
        word, args = (entry, None) if isinstance(entry, str) else (entry["rule"], entry.get("args"))
        if word == "references" and args:
            if args[1] not in (tables or {}):
                raise ValueError(f"unknown table {args[1]!r}")
            rules.append(references(args[0], tables[args[1]], *args[2:]))
            continue
        if word not in CONFIGURABLE:
            raise ValueError(f"unknown rule {word!r}; known: {sorted([*CONFIGURABLE, 'references'])}")
        build = CONFIGURABLE[word]
        rules += [build(c) for c in columns] if args is None else [build(*args)]
    return rules


def named_once(rules: Sequence[Rule]) -> None:
    """A name tells the results of one rule from those of another."""
    names = [r.name for r in rules]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"rules need different names; repeated: {repeated}")


def row_rules(rules: Sequence[Rule]) -> list[RowRule]:
    return [r for r in rules if isinstance(r, RowRule)]


def set_rules(rules: Sequence[Rule]) -> list[SetRule]:
    return [r for r in rules if not isinstance(r, RowRule)]


def any_broken(rules: Sequence[RowRule]) -> Column:
    return reduce(lambda a, b: a | b, [r.broken() for r in rules], F.lit(False))


def row_counts(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """One row per row rule with its violations and the run counters, all from one aggregation over the table.

    Columns: rule_name, rule_type, failed_count, records_processed, records_failed.
    """
    totals = [F.count(F.lit(1)).alias("records_processed"), F.count_if(any_broken(rules)).alias("records_failed")]
    counts = df.agg(*totals, *[F.count_if(r.broken()).alias(f"f{i}") for i, r in enumerate(rules)])
    entries = [
        F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.kind).alias("rule_type"), F.col(f"f{i}").alias("failed_count"))
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*entries)), "records_processed", "records_failed")


def failed_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_name, rule_type, failed_count): one scan for all row rules, one shuffle of keys per set rule."""
    named_once(rules)
    parts = []
    fused = row_rules(rules)
    if fused:
        parts.append(row_counts(df, fused).select("rule_name", "rule_type", "failed_count"))
    for rule in set_rules(rules):
        total = rule.failed(df).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("failed_count"))
        parts.append(total.select(F.lit(rule.name).alias("rule_name"), F.lit(rule.kind).alias("rule_type"), "failed_count"))
    return reduce(DataFrame.unionByName, parts)


def violations(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """Every violation: (rule_name, row, column, value), one row per rule, broken row and column of the rule.

    ``row`` is the text key of the row, ``value`` the offending value as text.
    """
    named_once(rules)
    parts = []
    fused = row_rules(rules)
    if fused:
        found = [F.when(r.broken(), _detail(r.name, c)) for r in fused for c in r.columns]
        cells = df.select(key_text(key).alias("row"), F.array(*found).alias("cells"))
        # The outer form of explode keeps the optimizer from evaluating all rules a second time in a filter.
        parts.append(cells.select("row", F.explode_outer("cells").alias("d")).where("d IS NOT NULL").select("row", "d.*"))
    for rule in set_rules(rules):
        details = F.inline_outer(F.array(*[_detail(rule.name, c) for c in rule.columns]))
        parts.append(rule.broken_rows(df).select(key_text(key).alias("row"), details))
    return reduce(DataFrame.unionByName, parts).select("rule_name", "row", "column", "value")


def _detail(rule: str, column: str) -> Column:
    value = F.col(column).cast("string")
    return F.struct(F.lit(rule).alias("rule_name"), F.lit(column).alias("column"), value.alias("value"))


def result_id(execution_id: str | int, rule: Column) -> Column:
    """The id of a rule's result in a run."""
    return F.md5(F.concat_ws("|", F.lit(str(execution_id)), rule))


def failure_rows(df: DataFrame, rules: Sequence[Rule], key: Sequence[str], execution_id: str | int) -> DataFrame:
    """Every violation as a row that belongs to a result of ``validate``: (result_id, rule_name, row, column, value)."""
    return violations(df, rules, key).select(result_id(execution_id, F.col("rule_name")).alias("result_id"), "*")


def validate(df: DataFrame, rules: Sequence[Rule], execution_id: str | int, run_time: dt.datetime) -> DataFrame:
    """The rules' results in the shape of the validation_results table.

    ``failure_details`` sums up all violations of a failed rule by column; ``failure_rows`` has them one by one.
    """
    moment = F.lit(run_time.isoformat(sep=" ")).cast("timestamp_ntz")
    columns = F.lit(None).cast("array<string>")
    for rule in rules:
        columns = F.when(F.col("rule_name") == rule.name, F.array(*map(F.lit, rule.columns))).otherwise(columns)
    entry = F.transform(columns, lambda c: F.struct(c.alias("column"), F.col("failed_count").alias("count")))
    return failed_counts(df, rules).select(
        result_id(execution_id, F.col("rule_name")).alias("id"),
        F.lit(execution_id).alias("execution_id"),
        "rule_name",
        "rule_type",
        (F.col("failed_count") == 0).alias("passed"),
        "failed_count",
        F.when(F.col("failed_count") > 0, F.to_json(entry)).otherwise("[]").alias("failure_details"),
        moment.alias("timestamp"),
    )


def mark(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with the array of the names of the rules that each row breaks.

    A set rule adds one join with its bad keys or its parents; adaptive execution splits frequent keys of ``df``.
    """
    named_once(rules)
    fused = row_rules(rules)
    none = F.array().cast("array<string>")
    names = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in fused])) if fused else none
    out = df.withColumn(MARK, F.when(any_broken(fused), names).otherwise(none))
    for i, rule in enumerate(set_rules(rules)):
        flag = f"_flag{i}"
        out = rule.flag(out, df, flag)
        extended = F.concat(F.col(MARK), F.array(F.lit(rule.name)))
        out = out.withColumn(MARK, F.when(F.col(flag), extended).otherwise(F.col(MARK))).drop(flag)
    return out


def write_split(df: DataFrame, rules: Sequence[Rule], path: str) -> None:
    """Write all rows with the rules they break, ``quality=good`` and ``quality=bad`` apart, in one evaluation."""
    quality = F.when(F.size(MARK) > 0, "bad").otherwise("good")
    mark(df, rules).withColumn("quality", quality).write.partitionBy("quality").parquet(path)


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): the rows that keep every rule, and the others with the names of the rules they break.

    Each of the two evaluates the rules when it is used; ``write_split`` does so once for both.
    """
    marked = mark(df, rules)
    return marked.where(F.size(MARK) == 0).drop(MARK), marked.where(F.size(MARK) > 0)


def run_counters(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(records_processed, records_failed) of a run: a failed row breaks at least one rule."""
    if set_rules(rules):
        rows, broken = mark(df, rules), F.size(MARK) > 0
    else:
        rows, broken = df, any_broken(row_rules(rules))
    return rows.agg(F.count(F.lit(1)).alias("records_processed"), F.count_if(broken).alias("records_failed"))
