"""Scalar expressions with the null and rounding rules of the relational model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Fractional seconds from ``start`` to ``end``, exact to the microsecond and without regard to time zones."""
    return duration(start, end).cast("interval second").cast("decimal(20,6)").cast("double")


def duration(start: str | Column, end: str | Column) -> Column:
    """``end - start`` as a day-time interval."""
    return col_of(end) - col_of(start)


def exact(c: str | Column) -> Column:
    """An integer column as a decimal, so that ratios do not go through floating point."""
    return col_of(c).cast("decimal(20,0)")


def percent(part: str | Column, whole: str | Column) -> Column:
    """``part / whole * 100`` as a decimal; null when ``whole`` is zero."""
    return exact(part) / F.nullif(exact(whole), F.lit(0).cast("decimal(20,0)")) * F.lit(100)


def failure_rate(failed: str | Column, processed: str | Column) -> Column:
    """Percentage with two places, half away from zero; 0 when nothing was processed or the count is unknown."""
    rate = F.round(percent(failed, processed), 2).cast("decimal(20,2)")
    return F.when(col_of(processed) > 0, rate).otherwise(F.lit(0).cast("decimal(20,2)"))


def mean_2dp(c: str | Column) -> Column:
    """``ROUND(AVG(c), 2)``, widened first so that the average itself is not rounded to a few places."""
    return F.round(F.avg(col_of(c).cast("decimal(28,12)")), 2)


def money_round(c: str | Column, places: int = 2) -> Column:
    """Round half to even, on the decimal value."""
    return F.bround(col_of(c).cast("decimal(28,6)"), places)


def trimmed_length(c: str | Column) -> Column:
    return F.length(F.trim(col_of(c)))


def array_length(c: str | Column) -> Column:
    """Number of entries; null for an empty or null array."""
    return F.when(F.size(col_of(c)) > 0, F.size(col_of(c)))


def json_value(c: str | Column, path: str, as_type: str) -> Column:
    """Typed value at a JSON path; null for malformed JSON or a missing path."""
    return F.try_variant_get(F.try_parse_json(col_of(c)), path, as_type)


def json_contains(c: str | Column, path: str, value: object, as_type: str = "string") -> Column:
    """True where the JSON document holds ``value`` at ``path``."""
    return json_value(c, path, as_type) == F.lit(value)


def null_or(c: str | Column, predicate: Column) -> Column:
    """``c IS NULL OR predicate``."""
    return col_of(c).isNull() | predicate


def sum_of(columns: list[str | Column]) -> Column:
    """Sum of several columns, as long integers."""
    return reduce(lambda a, b: a + b, [col_of(c).cast("bigint") for c in columns])


def uuid_from_hex(h: Column) -> Column:
    """32 uniform hex digits laid out as a version 4 UUID."""
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
