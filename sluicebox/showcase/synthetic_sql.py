"""SQL for keyed draws, synthetic columns and corruption, to check the DataFrame versions against."""

from __future__ import annotations

import datetime as dt

from sluicebox.functions import pools
from sluicebox.functions.pools import LOCALES
from sluicebox.operators.generate import SECONDS_PER_YEAR, Choice, ColumnSpec, Reference


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def hash_sql(seed: int, stream: str, key: str) -> str:
    return f"md5('{seed}|{stream}|' || CAST({key} AS VARCHAR))"


def draw_sql(seed: int, stream: str, key: str) -> str:
    return f"CAST('0x' || substr({hash_sql(seed, stream, key)}, 1, 12) AS BIGINT)"


def nth_sql(d: str, values: tuple[str, ...]) -> str:
    return f"list_extract({words(values)}, CAST(({d}) % {len(values)} AS BIGINT) + 1)"


def unit_sql(d: str) -> str:
    return f"(CAST({d} AS DOUBLE) / 281474976710656.0::DOUBLE)"


def uuid_sql(h: str) -> str:
    variant = f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || {variant} || "
        f"substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


def _digits(d: str, n: int) -> str:
    return f"lpad(CAST(({d}) % {10**n} AS VARCHAR), {n}, '0')"


def _sentence(seed: int, stream: str, key: str, pool: tuple[str, ...]) -> str:
    d = draw_sql(seed, stream, key)
    picks = ", ".join(nth_sql(f"({d} // {64**i})", pool) for i in range(8))
    length = f"(CAST('0x' || substr({hash_sql(seed, stream, key)}, 13, 4) AS BIGINT) % 5 + 4)"
    line = f"array_to_string(list_slice([{picks}], 1, {length}), ' ')"
    return f"(upper(substr({line}, 1, 1)) || substr({line}, 2) || '.')"


def column_sql(
    spec: ColumnSpec, name: str, key: str, seed: int, as_of: dt.datetime, locale: str = "es_ES"
) -> str:
    lo = LOCALES[locale]
    d, h = draw_sql(seed, name, key), hash_sql(seed, name, key)
    if isinstance(spec, Choice):
        if spec.weights is None:
            return nth_sql(d, spec.values)
        bounds, total = [], 0.0
        for value, weight in zip(spec.values[:-1], spec.weights[:-1]):
            total = round(total + weight, 12)
            bounds.append(f"WHEN {unit_sql(d)} < {total}::DOUBLE THEN {text(value)}")
        return f"CASE {' '.join(bounds)} ELSE {text(spec.values[-1])} END"
    if isinstance(spec, Reference):
        row = f"({draw_sql(seed, name + '|reference', key)} % {spec.rows})"
        return uuid_sql(hash_sql(seed, spec.stream, row))
    exact = f"TIMESTAMP '{as_of.isoformat(sep=' ')}'"
    whole = f"TIMESTAMP '{as_of.replace(microsecond=0).isoformat(sep=' ')}'"
    cents = f"(1000 + {d} % 999001)"
    names = " || ' ' || ".join(
        [nth_sql(d, lo.first_names)] + [nth_sql(f"({d} // {32 ** (i + 1)})", lo.last_names) for i in range(lo.last_names_per_person)]
    )
    local = f"{nth_sql(d, lo.first_names)} || '.' || {nth_sql(f'({d} // 32)', lo.last_names)}"
    email = (
        f"translate(lower({local}), '{pools.ACCENTED}', '{pools.FOLDED}') || CAST(({d} // 1024) % 1000 AS VARCHAR) || '@' || "
        + nth_sql(f"({d} // 1048576)", lo.email_domains)
    )
    address = (
        f"{nth_sql(d, lo.street_kinds)} || ' ' || {nth_sql(f'({d} // 4)', lo.last_names)} || ' ' || "
        f"CAST(({d} // 128) % 200 + 1 AS VARCHAR) || chr(10) || {_digits(f'({d} // 32768)', 5)} || ' ' || "
        f"{nth_sql(f'({d} // 4294967296)', lo.cities)}"
    )
    phone = f"'{lo.phone_prefix}' || {_digits(d, lo.phone_digits)}"
    moment = f"({whole} - to_seconds({d} % {SECONDS_PER_YEAR + 1}))"
    amount = f"(CAST({cents} AS DOUBLE) / 100)"
    known = {
        "int": f"{d} % 1000",
        "float": f"{unit_sql(d)} * 1000",
        "bool": f"{d} % 2 = 0",
        "string": nth_sql(d, lo.words),
        "name": names,
        "email": email,
        "phone": phone,
        "address": address,
        "company": f"{nth_sql(d, lo.last_names)} || ' ' || {nth_sql(f'({d} // 32)', lo.company_suffixes)}",
        "date": f"CAST(DATE '{as_of.date().isoformat()}' - CAST({d} % 366 AS INTEGER) AS DATE)",
        "datetime": moment,
        "timestamp": f"({exact} - to_seconds({d} % {SECONDS_PER_YEAR}))",
        "uuid": uuid_sql(h),
        "category": nth_sql(d, pools.CATEGORIES),
        "amount": amount,
        "price": amount,
        "first_name": nth_sql(d, lo.first_names),
        "last_name": nth_sql(d, lo.last_names),
        "phone_number": phone,
        "city": nth_sql(d, lo.cities),
        "country": nth_sql(d, lo.countries),
        "date_time": moment,
        "boolean": f"{d} % 2 = 0",
        "decimal": f"CAST({cents} / 100.0 AS DECIMAL(10,2))",
        "currency_code": nth_sql(d, pools.CURRENCY_CODES),
        "random_element": nth_sql(d, pools.RANDOM_ELEMENTS),
        "word": nth_sql(d, lo.words),
        "sentence": _sentence(seed, name, key, lo.words),
        "text": " || ' ' || ".join(_sentence(seed, f"{name}|{i}", key, lo.words) for i in range(3)),
    }
    return known.get(spec, f"{d} % 100")


def table_sql(
    schema: dict[str, ColumnSpec], source: str, key: str, seed: int, as_of: dt.datetime, locale: str = "es_ES", keep: str = "",
    stream: str = "",
) -> str:
    columns = [f"{column_sql(spec, stream + name, key, seed, as_of, locale)} AS \"{name}\"" for name, spec in schema.items()]
    return "SELECT " + (f"{keep}, " if keep else "") + ",\n  ".join(columns) + f" FROM {source}"


class CorruptionSql:
    """CTEs that repeat the corruption steps on one table with an integer key."""

    def __init__(self, source: str, columns: dict[str, str], key: str, seed: int):
        self.columns, self.key, self.seed = columns, key, seed
        names = ", ".join(columns)
        self.ctes = [f"t0 AS (SELECT {names}, CAST({key} AS VARCHAR) AS row_key FROM {source})",
                     "size AS (SELECT count(*) AS n FROM t0)"]
        self.version = 0

    def _hash(self, stream: str, place: int = 0) -> str:
        return f"substr({hash_sql(self.seed, f'{stream}|{place // 2}', 'row_key')}, {1 + 16 * (place % 2)}, 16)"

    def _next(self, changed: dict[str, str], sources: str = "") -> None:
        v = self.version
        picked = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in self.columns)
        self.ctes.append(f"t{v + 1} AS (SELECT {picked}, row_key FROM t{v}{sources})")
        self.version += 1

    def _cells(self, label: str, share: str, names: list[str]) -> str:
        """The largest hash among the cells hit by ``share`` draws over rows x names."""
        hits = f"{label}_hits{self.version}"
        self.ctes.append(
            f"{hits} AS (SELECT count(DISTINCT {draw_sql(self.seed, label + '-draw', 'j')} % ((SELECT n FROM size) * {len(names)})) AS k "
            f"FROM (SELECT unnest(range({share})) AS j))"
        )
        cells = " UNION ALL ".join(f"SELECT {self._hash(label, i)} AS h FROM t0" for i in range(len(names)))
        cut = f"{label}_cut{self.version}"
        self.ctes.append(f"{cut} AS (SELECT max(h) AS h FROM (SELECT h FROM ({cells}) ORDER BY h LIMIT (SELECT k FROM {hits})))")
        return cut

    def nulls(self, share: str) -> None:
        names = list(self.columns)
        cut = self._cells("null", share, names)
        keep = {c: f"CASE WHEN {self._hash('null', i)} > (SELECT h FROM {cut}) THEN {c} END" for i, c in enumerate(names)}
        self._next(keep)

    def type_errors(self, share: str, names: list[str], token: str) -> None:
        cut = self._cells("type", share, names)
        spoil = {
            c: f"CASE WHEN {self._hash('type', i)} <= (SELECT h FROM {cut}) THEN '{token}' ELSE CAST({c} AS VARCHAR) END"
            for i, c in enumerate(names)
        }
        self._next(spoil)

    def outliers(self, share: str, names: list[str], compound: bool = True) -> None:
        v = self.version
        self.ctes.append(
            f"draws{v} AS (SELECT j, {draw_sql(self.seed, 'outlier-column', 'j')} % {len(names)} AS c, "
            f"{draw_sql(self.seed, 'outlier-row', 'j')} % (SELECT n FROM size) AS r FROM (SELECT unnest(range({share})) AS j))"
        )
        self.ctes.append(
            f"last{v} AS (SELECT c, r, max(power) AS power FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY j) AS power "
            f"FROM draws{v}) GROUP BY c, r)"
        )
        self.ctes.append(
            f"ranked{v} AS (SELECT c, {'power' if compound else '1 AS power'}, "
            f"row_number() OVER (PARTITION BY c ORDER BY power) AS place FROM last{v})"
        )
        grown = []
        for i, c in enumerate(names):
            kind = self.columns[c]
            if kind == "DOUBLE":
                step, start = "v * 10", f"max({c})"
            else:
                top = {"BIGINT": 2**63 - 1, "INTEGER": 2**31 - 1}[kind]
                step, start = f"CASE WHEN v > {top // 10} THEN {top} ELSE v * 10 END", f"CAST(max({c}) AS BIGINT)"
            self.ctes.append(
                f"grow{v}_{i} AS (WITH RECURSIVE g(power, v) AS (SELECT 0, {start} FROM t{v} UNION ALL "
                f"SELECT power + 1, {step} FROM g WHERE power < (SELECT coalesce(max(power), 0) FROM ranked{v} WHERE c = {i})) SELECT * FROM g)"
            )
            self.ctes.append(
                f"hit{v}_{i} AS (SELECT k.row_key, g.v FROM (SELECT row_key, row_number() OVER (ORDER BY {self._hash('outlier', i)}) "
                f"AS place FROM t0) k JOIN ranked{v} p ON p.place = k.place AND p.c = {i} JOIN grow{v}_{i} g ON g.power = p.power)"
            )
            grown.append((c, i, kind))
        joins = "".join(f" LEFT JOIN hit{v}_{i} ON hit{v}_{i}.row_key = t{v}.row_key" for _, i, _ in grown)
        picked = {
            c: f"CASE WHEN hit{v}_{i}.row_key IS NOT NULL THEN CAST(hit{v}_{i}.v AS {kind}) ELSE t{v}.{c} END" for c, i, kind in grown
        }
        rest = ", ".join(f"{picked[c]} AS {c}" if c in picked else f"t{v}.{c}" for c in self.columns)
        self.ctes.append(f"t{v + 1} AS (SELECT {rest}, t{v}.row_key FROM t{v}{joins})")
        self.version += 1

    def duplicates(self, share: str) -> None:
        v = self.version
        self.ctes.append(
            f"copied{v} AS (SELECT row_key FROM t0 ORDER BY {self._hash('duplicate')} LIMIT (SELECT CAST({share} AS BIGINT) FROM size))"
        )
        names = ", ".join(self.columns)
        self.ctes.append(
            f"t{v + 1} AS (SELECT {names}, row_key FROM t{v} UNION ALL SELECT {names}, row_key FROM t{v} "
            f"WHERE row_key IN (SELECT row_key FROM copied{v}))"
        )
        self.version += 1

    def sql(self) -> str:
        return "WITH " + ",\n".join(self.ctes) + f"\nSELECT {', '.join(self.columns)} FROM t{self.version}"
