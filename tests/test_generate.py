from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sluicebox.operators.generate import (
    PREDEFINED_SCHEMAS, TYPE_WORDS, Choice, generate, generate_customers, generate_for, generate_predefined,
    generate_transactions,
)
from sluicebox.plans.sample_job import write_samples
from sluicebox.sources.delimited import read_csv

AS_OF = dt.datetime(2025, 3, 1, 12, 30, 5, 250000)


def test_rows_and_columns(spark):
    df = generate(spark, {"id": "int", "name": "string", "active": "bool"}, 100, seed=42)
    assert df.count() == 100
    assert df.columns == ["id", "name", "active"]


def test_numeric_types(spark):
    df = generate(spark, {"int_col": "int", "float_col": "float"}, 50, seed=42)
    assert dict(df.dtypes) == {"int_col": "bigint", "float_col": "double"}
    low, high = df.agg(F.min("int_col"), F.max("int_col")).first()
    assert 0 <= low and high <= 999


def test_text_is_never_null(spark):
    df = generate(spark, {"name": "name", "email": "email", "phone": "phone"}, 20, seed=42)
    rows = df.collect()
    assert all(r.name and r.phone and "@" in r.email for r in rows)
    assert all(re.fullmatch(r"[a-z]+\.[a-z]+[0-9]+@[a-z.]+", r.email) for r in rows)


def test_times_lie_in_the_last_year(spark):
    df = generate(spark, {"date": "date", "datetime": "datetime", "timestamp": "timestamp"}, 2000, seed=1, as_of=AS_OF)
    for r in df.collect():
        assert dt.date(2024, 2, 29) <= r.date <= AS_OF.date()
        assert AS_OF - dt.timedelta(days=365, seconds=1) <= r.datetime <= AS_OF and r.datetime.microsecond == 0
        assert AS_OF - dt.timedelta(days=365) < r.timestamp <= AS_OF and r.timestamp.microsecond == 250000


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_same_seed_same_values_whatever_the_partitions(spark, parts):
    schema = {word: word for word in TYPE_WORDS}
    once = generate(spark, schema, 200, seed=123, as_of=AS_OF)
    rows = spark.range(200).repartition(parts)
    again = generate_for(rows, ["id"], schema, 123, AS_OF)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_known_draw(spark):
    from sluicebox.functions.draws import draw

    assert spark.range(7, 8).select(draw(42, "c", F.col("id"))).first()[0] == 229575381385894


def test_other_seed_other_values(spark):
    a = generate(spark, {"value": "int"}, 50, seed=1).collect()
    assert a != generate(spark, {"value": "int"}, 50, seed=2).collect()
    assert generate(spark, {"value": "int"}, 50).collect() != generate(spark, {"value": "int"}, 50).collect()


def test_distributions(spark):
    schema = {"c": "category", "b": "bool", "a": "amount", "f": "float", "s": Choice(("x", "y", "z"), (0.85, 0.10, 0.05))}
    df = generate(spark, schema, 20000, seed=7)
    by_category = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    assert set(by_category) == {"A", "B", "C", "D"} and all(4700 < n < 5300 for n in by_category.values())
    by_status = {r.s: r["count"] / 20000 for r in df.groupBy("s").count().collect()}
    assert abs(by_status["x"] - 0.85) < 0.01 and abs(by_status["z"] - 0.05) < 0.01
    low, high, mean, cents, flow, fhigh, share = df.agg(
        F.min("a"), F.max("a"), F.avg("a"), F.max(F.abs(F.col("a") * 100 - F.round(F.col("a") * 100))), F.min("f"), F.max("f"),
        F.avg(F.col("b").cast("int")),
    ).first()
    assert 10 <= low and high <= 10000 and 4900 < mean < 5100 and cents < 1e-6
    assert 0 <= flow and fhigh < 1000 and abs(share - 0.5) < 0.02


def test_uuid_layout_and_uniqueness(spark):
    df = generate(spark, {"u": "uuid"}, 5000, seed=3)
    assert df.distinct().count() == 5000
    pattern = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    assert df.where(~F.col("u").rlike(pattern)).count() == 0


def test_unknown_word_warns(spark):
    with pytest.warns(UserWarning, match="unknown column type"):
        df = generate(spark, {"x": "whatever"}, 100, seed=1)
    assert 0 <= df.agg(F.min("x")).first()[0] and df.agg(F.max("x")).first()[0] <= 99


def test_unknown_locale(spark):
    with pytest.raises(ValueError, match="unknown locale"):
        generate(spark, {"x": "name"}, 1, locale="xx_XX")


def test_customers(spark):
    df = generate_customers(spark, 50, seed=42)
    assert df.count() == 50
    assert df.columns == [
        "customer_id", "name", "email", "phone", "address", "registration_date", "is_active", "lifetime_value",
    ]
    assert df.where(F.col("address").contains("\n")).count() == 50


def test_transactions(spark):
    df = generate_transactions(spark, 100, seed=42)
    assert df.count() == 100
    assert {r.category for r in df.collect()} <= {"Electronics", "Clothing", "Food", "Books", "Other"}
    assert {r.status for r in df.collect()} <= {"completed", "pending", "cancelled"}


def test_linked_transactions_find_their_customers(spark):
    customers = generate_customers(spark, 30, seed=42)
    linked = generate_transactions(spark, 200, num_customers=30, seed=42)
    assert linked.join(customers, "customer_id", "left_anti").count() == 0
    free = generate_transactions(spark, 200, seed=42)
    assert free.join(customers, "customer_id", "left_semi").count() == 0


@pytest.mark.parametrize("name", list(PREDEFINED_SCHEMAS))
def test_predefined(spark, name):
    df = generate_predefined(spark, name, 20, seed=5)
    assert df.columns == list(PREDEFINED_SCHEMAS[name])
    assert df.dropna().count() == 20


def test_one_stage_without_shuffle(spark):
    plan = generate_customers(spark, 10, seed=1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sample_job(spark, tmp_path):
    paths = write_samples(spark, str(tmp_path), as_of=AS_OF)
    counts = {name: read_csv(spark, path).count() for name, path in paths.items()}
    assert counts == {"customers": 1000, "transactions": 5000, "data_with_anomalies": 516}
    spoiled = read_csv(spark, paths["data_with_anomalies"])
    assert spoiled.columns == ["id", "name", "email", "amount", "date"]
