"""Run a registered query and its SQL, and compare the rows without regard to order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value.normalize()))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def spark_type(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def compare(spark, folder, run, sql, con=None) -> list[str]:
    """Differences between the query and its SQL; empty when they agree."""
    con = con or duck(folder)
    df = run(spark, folder)
    types = spark_type(df)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    duck_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name in names:
        expected = SAME_TYPE.get(types[name])
        if expected and expected != duck_types[name]:
            problems.append(f"type of {name}: {types[name]} / {duck_types[name]}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    if ours != theirs:
        both = set(ours) & set(theirs)
        a = [r for r in ours if r not in both][:3]
        b = [r for r in theirs if r not in both][:3]
        problems.append(f"values differ: spark {a} sql {b}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from conftest import make_session

    folder = argv[0]
    only = argv[1:]
    spark = make_session()
    con = duck(folder)
    failed = 0
    for name, run in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        began = time.time()
        try:
            if name in entry.oracle_sql():
                problems = compare(spark, folder, run, entry.oracle_sql()[name], con)
            else:
                n = run(spark, folder).count()
                problems = [] if n else ["no rows"]
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {time.time() - began:6.1f}s {name}", flush=True)
        for p in problems:
            print("      ", p[:1800], flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
