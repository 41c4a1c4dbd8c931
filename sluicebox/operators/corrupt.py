"""Controlled corruption: nulls, outliers, duplicates and type errors at an exact, reproducible rate.

Rows are hit where the keyed hash of (seed, step, column, row key) is among the smallest. That is decided row by row,
so the table itself is never shuffled, sorted or numbered; only counts of hash prefixes are. ``key`` names the columns
that identify a row. The input must give the same rows each time it is read (a file scan, a generated table).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.draws import draw, key_text, new_seed
from sluicebox.operators.selection import Hashes, cell_hash, smallest_cutoffs, smallest_hashes

DEFAULT_KINDS = ("nulls", "outliers", "duplicates")
KINDS = ("nulls", "outliers", "type_errors", "duplicates")  # in the order in which they are applied
TYPE_ERROR_TOKEN = "#type-error"
# Ten to this power is beyond any double, whatever the maximum it multiplies: later hits are all alike.
LAST_RANK = 700
INTEGRAL_MAX = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}
HIDDEN_KEY = "_row_key"


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns; booleans are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else _col(c) for c in df.columns])


def _distinct_hits(spark: SparkSession, seed: int, stream: str, count: int, cells: int) -> int:
    """How many different cells ``count`` draws with replacement out of ``cells`` hit."""
    if count <= 0 or cells <= 0:
        return 0
    return spark.range(count).select(draw(seed, stream, F.col("id")) % cells).distinct().count()


@dataclass
class _Target:
    """The table to corrupt, with the text key its rows had before any cell was changed."""

    df: DataFrame
    names: list[str]
    rows: int
    seed: int

    def hash(self, stream: str, place: int = 0) -> Column:
        return cell_hash(self.seed, stream, _col(HIDDEN_KEY), place)


@dataclass
class _Step:
    """One kind of corruption: the hashes it ranks, how many of each label it hits, and how it rewrites the table."""

    target: _Target
    count: int
    columns: list[str]
    hashes: Hashes = field(default_factory=list)
    wanted: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.plan()

    def plan(self) -> None:
        raise NotImplementedError

    def apply(self, df: DataFrame, cutoffs: dict[str, str]) -> DataFrame:
        raise NotImplementedError

    def _cells_together(self, label: str) -> None:
        t = self.target
        cells = t.rows * len(self.columns)
        hits = _distinct_hits(t.df.sparkSession, t.seed, f"{label}-draw", self.count, cells)
        self.hashes = [(label, t.hash(label, i)) for i, _ in enumerate(self.columns)]
        self.wanted = {label: hits}


class _Nulls(_Step):
    """The draws fix how many different cells are hit, the keyed hash fixes which."""

    def plan(self) -> None:
        self._cells_together("null")

    def apply(self, df: DataFrame, cutoffs: dict[str, str]) -> DataFrame:
        cells = zip(self.columns, self.hashes)
        return _replace(df, {c: F.when(h > cutoffs["null"], _col(c)) for c, (_, h) in cells})


class _TypeErrors(_Step):
    token = TYPE_ERROR_TOKEN

    def plan(self) -> None:
        self._cells_together("type")

    def apply(self, df: DataFrame, cutoffs: dict[str, str]) -> DataFrame:
        hit = {c: h <= cutoffs["type"] for c, (_, h) in zip(self.columns, self.hashes)}
        return _replace(
            df, {c: F.when(is_hit, F.lit(self.token)).otherwise(_col(c).cast("string")) for c, is_hit in hit.items()}
        )


class _Duplicates(_Step):
    def plan(self) -> None:
        if self.count > self.target.rows:
            raise ValueError(f"cannot copy {self.count} different rows out of {self.target.rows}")
        self.hashes = [("duplicate", self.target.hash("duplicate"))]
        self.wanted = {"duplicate": self.count}

    def apply(self, df: DataFrame, cutoffs: dict[str, str]) -> DataFrame:
        is_hit = self.hashes[0][1] <= cutoffs["duplicate"]
        copies = F.when(is_hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return df.select("*", F.explode_outer(copies).alias("_copy")).drop("_copy")


@dataclass
class _Outliers(_Step):
    compound: bool = True
    ranks: dict[str, list[int]] = field(default_factory=dict)

    def plan(self) -> None:
        t = self.target
        if not self.columns or self.count <= 0 or t.rows == 0:
            self.columns = []
            return
        draws = t.df.sparkSession.range(self.count).select(
            F.col("id").alias("j"),
            (draw(t.seed, "outlier-column", F.col("id")) % len(self.columns)).cast("int").alias("column"),
            (draw(t.seed, "outlier-row", F.col("id")) % t.rows).alias("row"),
        )
        last = draws.groupBy("column", "row").agg(F.max("j").alias("j"))
        names = list(self.columns)
        hits = {names[r["column"]]: r["count"] for r in last.groupBy("column").count().collect()}
        self.columns = [c for c in names if hits.get(c)]
        self.hashes = [(f"outlier|{c}", t.hash("outlier", names.index(c))) for c in self.columns]
        self.wanted = {f"outlier|{c}": hits[c] for c in self.columns}
        self.ranks = _surviving_ranks(draws, last, names) if self.compound else {}

    def apply(self, df: DataFrame, cutoffs: dict[str, str]) -> DataFrame:
        if not self.columns:
            return df
        maxima = df.agg(*[F.max(comparable(df, c)).alias(c) for c in self.columns]).first().asDict()
        labels = {c: f"outlier|{c}" for c in self.columns}
        wanted = {labels[c]: len(r) for c, r in self.ranks.items()}
        smallest = smallest_hashes(df, self.hashes, cutoffs, wanted)
        changed = {}
        for c, (label, h) in zip(self.columns, self.hashes):
            dtype = df.schema[c].dataType
            value = F.lit(outlier_value(maxima[c], LAST_RANK if self.compound else 1, dtype)).cast(dtype)
            first = smallest.get(label)
            if first and maxima[c] is not None:
                powers = _constants([outlier_value(maxima[c], r, dtype) for r in self.ranks[c]], dtype)
                at = F.array_position(_constants(first, T.StringType()), h).cast("int")
                value = F.when(h <= first[-1], F.element_at(powers, at)).otherwise(value)
            changed[c] = F.when(h <= cutoffs[label], value).otherwise(_col(c))
        return _replace(df, changed)


def _constants(values: Sequence[object], dtype: T.DataType) -> Column:
    """An array literal. It is built from one text, as hundreds of single literals are slow to plan."""
    shown = [format(v, "f") if isinstance(v, Decimal) else str(v) for v in values]
    return F.split(F.lit(",".join(shown)), ",").cast(T.ArrayType(dtype))


def _surviving_ranks(draws: DataFrame, last: DataFrame, names: list[str]) -> dict[str, list[int]]:
    """Per column, the ranks up to LAST_RANK of the draws that no later draw on the same cell overwrites.

    The rank bound is applied inside each task before the shuffle.
    """
    order = Window.partitionBy("column").orderBy("j")
    early = draws.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LAST_RANK)
    kept = early.join(last, ["column", "row", "j"], "left_semi").select("column", "rank").collect()
    ranks: dict[str, list[int]] = {}
    for r in sorted(kept):
        ranks.setdefault(names[r["column"]], []).append(r["rank"])
    return ranks


def comparable(df: DataFrame, c: str) -> Column:
    """The column without NaN, which would otherwise be the maximum."""
    floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
    return F.when(~F.isnan(_col(c)), _col(c)) if floating else _col(c)


def outlier_value(maximum: object, power: int, dtype: T.DataType) -> object:
    """``maximum`` multiplied by ten ``power`` times; a maximum that is not positive does not grow with later hits."""
    if maximum is None:
        return None
    if maximum <= 0:
        power = 1
    if isinstance(dtype, T.DecimalType):
        largest = 10 ** (dtype.precision - dtype.scale) - 1
        grown = maximum
        for _ in range(power):
            grown *= 10
            if abs(grown) > largest:
                return largest if grown > 0 else -largest
        return grown
    if isinstance(dtype, T.IntegralType):
        largest = INTEGRAL_MAX[dtype.simpleString()]
        return max(min(int(maximum) * 10**power, largest), -largest)
    value = float(maximum)
    for _ in range(power):
        value *= 10
        if math.isinf(value):
            break
    return value


def _prepare(df: DataFrame, key: Sequence[str], seed: int | None, drop_key: bool = False) -> _Target:
    keyed = df.withColumn(HIDDEN_KEY, key_text(key)).drop(*(key if drop_key else ()))
    names = [c for c in keyed.columns if c != HIDDEN_KEY]
    return _Target(keyed, names, df.count(), new_seed() if seed is None else seed)


def _run(target: _Target, steps: list[_Step]) -> DataFrame:
    """Find the cutoffs of all steps in the same passes over the keys, then rewrite the table row by row."""
    hashes = [pair for s in steps for pair in s.hashes]
    wanted = {label: k for s in steps for label, k in s.wanted.items()}
    cutoffs = smallest_cutoffs(target.df, hashes, wanted, target.rows)
    out = target.df
    for s in steps:
        out = s.apply(out, cutoffs)
    return out.select(*[_col(c) for c in target.names])


def inject_nulls(
    df: DataFrame, count: int, key: Sequence[str], seed: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Blank the cells hit by ``count`` draws with replacement over rows x columns: at most ``count`` cells."""
    t = _prepare(df, key, seed)
    return _run(t, [_Nulls(t, count, list(columns or df.columns))])


def inject_outliers(
    df: DataFrame, count: int, key: Sequence[str], seed: int | None = None, columns: Sequence[str] | None = None,
    compound: bool = True,
) -> DataFrame:
    """Overwrite the numeric cells hit by ``count`` draws with ten times the column maximum.

    With ``compound`` the maximum is read again for each hit, so the k-th hit on a column writes ``max * 10**k``;
    the last hit on a cell wins. Without it every hit writes ``max * 10``. Integers and decimals stop at the largest
    value of their type, doubles run into infinity. Without numeric columns the table is returned unchanged.
    """
    t = _prepare(df, key, seed)
    return _run(t, [_Outliers(t, count, _numeric(df, columns), compound=compound)])


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return numeric_columns(df) if columns is None else list(columns)


def inject_duplicates(df: DataFrame, count: int, key: Sequence[str], seed: int | None = None) -> DataFrame:
    """Copy ``count`` different rows once."""
    t = _prepare(df, key, seed)
    return _run(t, [_Duplicates(t, count, [])])


def inject_type_errors(
    df: DataFrame, count: int, key: Sequence[str], seed: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Turn columns (the numeric ones by default) into text and spoil the cells hit by ``count`` draws."""
    t = _prepare(df, key, seed)
    return _run(t, [_TypeErrors(t, count, _numeric(df, columns))])


def poison(
    df: DataFrame, key: Sequence[str], rate: float, target_fields: Sequence[str], seed: int | None = None,
    compound: bool = False,
) -> DataFrame:
    """Outliers in the named fields only: ``rate`` times the number of rows as draws."""
    t = _prepare(df, key, seed)
    return _run(t, [_Outliers(t, int(t.rows * rate), list(target_fields), compound=compound)])


def inject_anomalies(
    df: DataFrame, key: Sequence[str], anomaly_rate: float = 0.05, anomaly_types: Sequence[str] | None = None,
    seed: int | None = None, compound: bool = True, drop_key: bool = False,
) -> DataFrame:
    """Apply the named kinds, each with an equal share of ``int(rows * anomaly_rate)``.

    The order is fixed: nulls, outliers, type errors, duplicates. Copies therefore include corrupted cells.
    An unknown kind does nothing but takes its share. ``drop_key`` keeps the key columns out of the corruption and
    out of the result.
    """
    kinds = list(DEFAULT_KINDS if anomaly_types is None else anomaly_types)
    t = _prepare(df, key, seed, drop_key)
    if not kinds:
        return df.select(*t.names)
    share = int(t.rows * anomaly_rate) // len(kinds)
    numeric = [c for c in numeric_columns(t.df) if c in t.names]
    build = {
        "nulls": lambda: _Nulls(t, share, t.names),
        "outliers": lambda: _Outliers(t, share, numeric, compound=compound),
        "type_errors": lambda: _TypeErrors(t, share, numeric),
        "duplicates": lambda: _Duplicates(t, share, []),
    }
    return _run(t, [build[kind]() for kind in KINDS if kind in kinds])
