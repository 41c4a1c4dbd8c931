"""Synthetic tables: one column expression per type word, over ``spark.range`` or over the keys of any table."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import pools
from sluicebox.functions.draws import draw, key_text, keyed_hash, new_seed, number, unit
from sluicebox.functions.pools import LOCALES, Locale
from sluicebox.functions.scalars import uuid_from_hex

SECONDS_PER_YEAR = 365 * 86_400
ROW = "_row"
# Streams of the ready-made tables.
CUSTOMERS = "customers."
TRANSACTIONS = "transactions."


@dataclass(frozen=True)
class Choice:
    """A column drawn from fixed values, uniformly or with weights that add up to one."""

    values: tuple[str, ...]
    weights: tuple[float, ...] | None = None


@dataclass(frozen=True)
class Reference:
    """UUIDs of another generated table: the column with this ``stream`` of a table of ``rows`` rows, same seed."""

    stream: str
    rows: int


ColumnSpec = str | Choice | Reference


@dataclass(frozen=True)
class _Cell:
    """What a type word may use: the draws of one column, the locale and the reference time."""

    seed: int
    stream: str
    key: Column
    locale: Locale
    as_of: dt.datetime

    def draw(self, suffix: str = "") -> Column:
        return draw(self.seed, self.stream + suffix, self.key)

    def hash(self) -> Column:
        return keyed_hash(self.seed, self.stream, self.key)

    def now(self, whole_seconds: bool = False) -> Column:
        moment = self.as_of.replace(microsecond=0) if whole_seconds else self.as_of
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _nth(d: Column, pool: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in pool]), (d % len(pool) + 1).cast("int"))


def _digits(d: Column, n: int) -> Column:
    return F.lpad((d % 10**n).cast("string"), n, "0")


def _int_div(d: Column, by: int) -> Column:
    return F.call_function("div", d, F.lit(by).cast("bigint"))


def _name(c: _Cell) -> Column:
    d, lo = c.draw(), c.locale
    parts = [_nth(d, lo.first_names)]
    for i in range(lo.last_names_per_person):
        parts.append(_nth(_int_div(d, 32 ** (i + 1)), lo.last_names))
    return F.concat_ws(" ", *parts)


def _email(c: _Cell) -> Column:
    d, lo = c.draw(), c.locale
    first, last = _nth(d, lo.first_names), _nth(_int_div(d, 32), lo.last_names)
    local = F.translate(F.lower(F.concat(first, F.lit("."), last)), pools.ACCENTED, pools.FOLDED)
    number = (_int_div(d, 1024) % 1000).cast("string")
    return F.concat(local, number, F.lit("@"), _nth(_int_div(d, 1_048_576), lo.email_domains))


def _phone(c: _Cell) -> Column:
    return F.concat(F.lit(c.locale.phone_prefix), _digits(c.draw(), c.locale.phone_digits))


def _address(c: _Cell) -> Column:
    d, lo = c.draw(), c.locale
    street = F.concat_ws(" ", _nth(d, lo.street_kinds), _nth(_int_div(d, 4), lo.last_names))
    number = (_int_div(d, 128) % 200 + 1).cast("string")
    town = F.concat_ws(" ", _digits(_int_div(d, 32_768), 5), _nth(_int_div(d, 4_294_967_296), lo.cities))
    return F.concat(street, F.lit(" "), number, F.lit("\n"), town)


def _company(c: _Cell) -> Column:
    d = c.draw()
    return F.concat_ws(" ", _nth(d, c.locale.last_names), _nth(_int_div(d, 32), c.locale.company_suffixes))


def _date(c: _Cell) -> Column:
    return F.date_sub(F.lit(c.as_of.date()), (c.draw() % 366).cast("int"))


def _datetime(c: _Cell) -> Column:
    return F.timestamp_add("SECOND", -(c.draw() % (SECONDS_PER_YEAR + 1)), c.now(whole_seconds=True))


def _timestamp(c: _Cell) -> Column:
    return F.timestamp_add("SECOND", -(c.draw() % SECONDS_PER_YEAR), c.now())


def _cents(c: _Cell) -> Column:
    return F.lit(1000).cast("bigint") + c.draw() % 999_001


def _sentence(c: _Cell, suffix: str = "") -> Column:
    """Four to eight words: six bits of the draw each, the length from the next digits of the same hash."""
    h = keyed_hash(c.seed, c.stream + suffix, c.key)
    length = (number(h, 13, 4) % 5 + 4).cast("int")
    capitals = tuple(w[0].upper() + w[1:] for w in c.locale.words)

    def word(d: Column, i: Column) -> Column:
        bits = F.call_function("shiftright", d, i * 6)
        return F.when(i == 0, _nth(bits, capitals)).otherwise(_nth(bits, c.locale.words))

    # A lambda over the places keeps the generated code small enough to be compiled.
    return F.concat(F.array_join(F.transform(F.array_repeat(number(h, 1, 12), length), word), " "), F.lit("."))


def _text(c: _Cell) -> Column:
    return F.concat_ws(" ", *[_sentence(c, f"|{i}") for i in range(3)])


TYPE_WORDS: dict[str, Callable[[_Cell], Column]] = {
    "int": lambda c: c.draw() % 1000,
    "float": lambda c: unit(c.draw()) * 1000,
    "bool": lambda c: c.draw() % 2 == 0,
    "string": lambda c: _nth(c.draw(), c.locale.words),
    "name": _name,
    "email": _email,
    "phone": _phone,
    "address": _address,
    "company": _company,
    "date": _date,
    "datetime": _datetime,
    "timestamp": _timestamp,
    "uuid": lambda c: uuid_from_hex(c.hash()),
    "category": lambda c: _nth(c.draw(), pools.CATEGORIES),
    "amount": lambda c: _cents(c).cast("double") / 100,
    "price": lambda c: _cents(c).cast("double") / 100,
    # Words used by the predefined schemas.
    "first_name": lambda c: _nth(c.draw(), c.locale.first_names),
    "last_name": lambda c: _nth(c.draw(), c.locale.last_names),
    "phone_number": _phone,
    "city": lambda c: _nth(c.draw(), c.locale.cities),
    "country": lambda c: _nth(c.draw(), c.locale.countries),
    "date_time": _datetime,
    "boolean": lambda c: c.draw() % 2 == 0,
    "decimal": lambda c: (_cents(c).cast("decimal(12,2)") / 100).cast("decimal(10,2)"),
    "currency_code": lambda c: _nth(c.draw(), pools.CURRENCY_CODES),
    "random_element": lambda c: _nth(c.draw(), pools.RANDOM_ELEMENTS),
    "word": lambda c: _nth(c.draw(), c.locale.words),
    "sentence": _sentence,
    "text": _text,
}

# Columns and type words of the ready-made tables. Fixed values.
PREDEFINED_SCHEMAS: dict[str, dict[str, ColumnSpec]] = {
    "customers": {
        "customer_id": "uuid", "first_name": "first_name", "last_name": "last_name", "email": "email",
        "phone": "phone_number", "address": "address", "city": "city", "country": "country",
        "registration_date": "date_time", "is_active": "boolean",
    },
    "transactions": {
        "transaction_id": "uuid", "customer_id": "uuid", "amount": "decimal", "currency": "currency_code",
        "transaction_date": "date_time", "status": "random_element", "description": "sentence",
    },
    "products": {
        "product_id": "uuid", "name": "word", "category": "word", "price": "decimal", "stock": "int",
        "description": "text", "created_at": "date_time",
    },
}

CUSTOMER_SCHEMA: dict[str, ColumnSpec] = {
    "customer_id": "uuid", "name": "name", "email": "email", "phone": "phone", "address": "address",
    "registration_date": "date", "is_active": "bool", "lifetime_value": "amount",
}

TRANSACTION_SCHEMA: dict[str, ColumnSpec] = {
    "transaction_id": "uuid", "customer_id": "uuid", "timestamp": "datetime", "amount": "amount",
    "category": Choice(("Electronics", "Clothing", "Food", "Books", "Other")),
    "status": Choice(("completed", "pending", "cancelled"), (0.85, 0.10, 0.05)),
}


def _choice(spec: Choice, c: _Cell) -> Column:
    if spec.weights is None:
        return _nth(c.draw(), spec.values)
    if len(spec.weights) != len(spec.values) or abs(sum(spec.weights) - 1) > 1e-9:
        raise ValueError("weights must match the values and add up to one")
    u, bound, picked = unit(c.draw()), 0.0, None
    for value, weight in zip(spec.values[:-1], spec.weights[:-1]):
        bound = round(bound + weight, 12)
        picked = F.when(u < bound, value) if picked is None else picked.when(u < bound, value)
    last = F.lit(spec.values[-1])
    return last if picked is None else picked.otherwise(last)


def column_for(
    spec: ColumnSpec, stream: str, key: Column, seed: int, as_of: dt.datetime, locale: str | Locale = "es_ES"
) -> Column:
    """The expression of one synthetic column; columns with the same seed, stream and key are equal."""
    words = LOCALES.get(locale) if isinstance(locale, str) else locale
    if words is None:
        raise ValueError(f"unknown locale {locale!r}; known: {sorted(LOCALES)}")
    cell = _Cell(seed, stream, key, words, as_of)
    if isinstance(spec, Choice):
        return _choice(spec, cell)
    if isinstance(spec, Reference):
        row = cell.draw("|reference") % spec.rows
        return uuid_from_hex(keyed_hash(seed, spec.stream, row))
    if spec not in TYPE_WORDS:
        warnings.warn(f"unknown column type {spec!r}: using integers 0..99", stacklevel=3)
        return cell.draw() % 100
    return TYPE_WORDS[spec](cell)


def generate_for(
    df: DataFrame,
    key: Sequence[str],
    schema: Mapping[str, ColumnSpec],
    seed: int | None = None,
    as_of: dt.datetime | None = None,
    locale: str | Locale = "es_ES",
    keep: Sequence[str | Column] = (),
    stream: str = "",
) -> DataFrame:
    """One synthetic row per row of ``df``, drawn by its key; ``keep`` names columns of ``df`` to carry along.

    Each column draws from the stream of its name; the prefix ``stream`` sets tables with equal column names apart.
    """
    seed = new_seed() if seed is None else seed
    as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = key_text(key)
    made = [column_for(spec, stream + name, row, seed, as_of, locale).alias(name) for name, spec in schema.items()]
    return df.select(*keep, *made)


def generate(
    spark: SparkSession,
    schema: Mapping[str, ColumnSpec],
    num_records: int = 1000,
    seed: int | None = None,
    as_of: dt.datetime | None = None,
    locale: str | Locale = "es_ES",
    stream: str = "",
) -> DataFrame:
    """A table of ``num_records`` rows with one column per schema entry, in schema order."""
    rows = spark.range(num_records).withColumnRenamed("id", ROW)
    return generate_for(rows, [ROW], schema, seed, as_of, locale, stream=stream)


def generate_customers(spark: SparkSession, num_customers: int = 1000, **options) -> DataFrame:
    return generate(spark, CUSTOMER_SCHEMA, num_customers, stream=CUSTOMERS, **options)


def generate_transactions(
    spark: SparkSession, num_transactions: int = 10_000, num_customers: int | None = None, **options
) -> DataFrame:
    """Transactions; with ``num_customers``, their customer ids are those of ``generate_customers`` (same seed)."""
    schema = dict(TRANSACTION_SCHEMA)
    if num_customers is not None:
        schema["customer_id"] = Reference(CUSTOMERS + "customer_id", num_customers)
    return generate(spark, schema, num_transactions, stream=TRANSACTIONS, **options)


def generate_predefined(spark: SparkSession, name: str, num_records: int = 1000, **options) -> DataFrame:
    return generate(spark, PREDEFINED_SCHEMAS[name], num_records, stream=f"{name}.", **options)
