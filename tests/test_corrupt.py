from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.operators import corrupt
from sluicebox.operators import rules as R
from sluicebox.operators.generate import generate, generate_for
from sluicebox.operators.profile import null_cells
from sluicebox.operators.selection import cell_hash, smallest_cutoffs


def table(spark, n=100, **schema):
    return generate_for(spark.range(n), ["id"], schema or {"col1": "int", "col2": "int", "col3": "int"}, 42, keep=["id"])


def nulls(df):
    return null_cells(df).first()[0]


def test_nulls(spark):
    df = table(spark)
    assert nulls(df) == 0
    spoiled = corrupt.inject_anomalies(df, ["id"], 0.1, ["nulls"], seed=1)
    assert 0 < nulls(spoiled) <= 10
    assert spoiled.count() == 100 and spoiled.columns == df.columns
    assert nulls(df) == 0


def test_null_draws_repeat_cells(spark):
    """With many draws on few cells the number of different cells follows the draws."""
    df = table(spark, 10, a="int")
    spoiled = corrupt.inject_nulls(df, 20, ["id"], seed=3, columns=["a"])
    assert 5 <= spoiled.where("a IS NULL").count() < 10


def test_outliers(spark):
    df = generate(spark, {"value": "float"}, 100, seed=42).withColumn("id", F.monotonically_increasing_id())
    top = df.agg(F.max("value")).first()[0]
    spoiled = corrupt.inject_outliers(df, 5, ["id"], seed=1, columns=["value"])
    assert spoiled.agg(F.max("value")).first()[0] > top * 5


def test_outliers_compound(spark):
    """The k-th hit writes max * 10**k; hits on the same cell leave only the last."""
    df = table(spark, 1000, v="float")
    top = df.agg(F.max("v")).first()[0]
    spoiled = corrupt.inject_outliers(df, 5, ["id"], seed=2, columns=["v"])
    found = sorted(r.v for r in spoiled.where(F.col("v") > top).collect())
    expected, value = [], top
    for _ in range(5):
        value *= 10
        expected.append(value)
    assert found == expected


def test_outliers_flat(spark):
    df = table(spark, 1000, v="float")
    top = df.agg(F.max("v")).first()[0]
    spoiled = corrupt.inject_outliers(df, 50, ["id"], seed=2, columns=["v"], compound=False)
    found = {r.v for r in spoiled.where(F.col("v") > top).collect()}
    assert found == {top * 10}


def test_outliers_saturate(spark):
    assert corrupt.outlier_value(999, 30, T.LongType()) == 2**63 - 1
    assert corrupt.outlier_value(999, 30, T.IntegerType()) == 2**31 - 1
    assert math.isinf(corrupt.outlier_value(1.0, 700, T.DoubleType()))
    assert corrupt.outlier_value(-3, 9, T.LongType()) == -30
    assert corrupt.outlier_value(0.0, 700, T.DoubleType()) == 0.0
    assert corrupt.outlier_value(None, 1, T.LongType()) is None


def test_outliers_need_numbers(spark):
    df = spark.createDataFrame([(f"k{i}", True) for i in range(20)], "k string, b boolean")
    assert sorted(corrupt.inject_outliers(df, 5, ["k"], seed=1).collect()) == sorted(df.collect())


def test_duplicates(spark):
    df = table(spark)
    spoiled = corrupt.inject_anomalies(df, ["id"], 0.1, ["duplicates"], seed=1)
    assert spoiled.count() == 110
    assert spoiled.groupBy("id").count().where("count = 2").count() == 10


def test_too_many_duplicates(spark):
    with pytest.raises(ValueError):
        corrupt.inject_duplicates(table(spark, 10), 11, ["id"], seed=1)
    assert corrupt.inject_duplicates(table(spark, 10), 10, ["id"], seed=1).count() == 20


def test_worked_example(spark):
    schema = {"number": "int", "name": "name", "email": "email", "amount": "amount", "date": "date"}
    df = table(spark, 500, **schema)
    spoiled = corrupt.inject_anomalies(df, ["id"], 0.10, ["nulls", "outliers", "duplicates"], seed=42, drop_key=True)
    assert spoiled.count() == 516
    assert spoiled.columns == list(schema)
    assert nulls(spoiled) <= 32


def test_order_of_kinds_does_not_matter(spark):
    df = table(spark)
    a = corrupt.inject_anomalies(df, ["id"], 0.3, ["nulls", "duplicates", "outliers"], seed=9)
    b = corrupt.inject_anomalies(df, ["id"], 0.3, ["duplicates", "outliers", "nulls"], seed=9)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_unknown_kind_takes_its_share(spark):
    df = table(spark)
    assert corrupt.inject_anomalies(df, ["id"], 0.1, ["duplicates", "something"], seed=1).count() == 105


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_same_result_whatever_the_partitions(spark, parts):
    df = table(spark)
    once = corrupt.inject_anomalies(df, ["id"], 0.3, seed=5)
    again = corrupt.inject_anomalies(df.repartition(parts), ["id"], 0.3, seed=5)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_type_errors(spark):
    spoiled = corrupt.inject_type_errors(table(spark), 10, ["id"], seed=1, columns=["col1"])
    assert dict(spoiled.dtypes)["col1"] == "string"
    hit = spoiled.where(F.col("col1") == corrupt.TYPE_ERROR_TOKEN).count()
    assert 0 < hit <= 10 and spoiled.where(F.col("col1").try_cast("bigint").isNull()).count() == hit


def test_poison_touches_only_its_fields(spark):
    df = table(spark, 200, amount="amount", other="amount")
    spoiled = corrupt.poison(df, ["id"], 0.05, ["amount"], seed=1)
    joined = df.alias("a").join(spoiled.alias("b"), "id")
    assert joined.where("a.other <> b.other").count() == 0
    assert 0 < joined.where("a.amount <> b.amount").count() <= 10


@pytest.mark.parametrize("rate", [0.0, 1.0])
def test_extreme_rates(spark, rate):
    spoiled = corrupt.inject_anomalies(table(spark, 30), ["id"], rate, seed=1)
    assert spoiled.count() == 30 + (10 if rate else 0)


def test_empty_table(spark):
    df = table(spark, 10).where("id < 0")
    assert corrupt.inject_anomalies(df, ["id"], 0.5, seed=1).count() == 0


def test_all_null_column(spark):
    df = spark.range(20).withColumn("x", F.lit(None).cast("double"))
    spoiled = corrupt.inject_outliers(df, 10, ["id"], seed=1, columns=["x"])
    assert spoiled.where("x IS NOT NULL").count() == 0


def test_equal_keys_at_the_cutoff_are_refused(spark):
    df = spark.range(50).withColumn("k", F.lit("same"))
    with pytest.raises(ValueError, match="do not identify"):
        corrupt.inject_duplicates(df, 10, ["k"], seed=1)


def test_corrupted_rows_are_found_by_rules(spark):
    df = table(spark, 500, amount="amount", name="name")
    spoiled = corrupt.inject_anomalies(df, ["id"], 0.3, seed=11, compound=False)
    rules = [R.not_null("id"), R.not_null("amount"), R.not_null("name"), R.in_range("amount", 10, 10000), R.unique("id")]
    failed = {r.rule_name: r.failed_count for r in R.failed_counts(spoiled, rules).collect()}
    assert failed["id_not_null"] + failed["amount_not_null"] + failed["name_not_null"] == nulls(spoiled)
    assert failed["amount_range"] > 0 and failed["id_unique"] > 0


@pytest.mark.parametrize("k", [0, 1, 7, 500, 4999, 5000])
@pytest.mark.parametrize("known", [True, False])
def test_cutoffs_are_exact(spark, k, known):
    df = spark.range(5000).withColumn("h", cell_hash(1, "s", F.col("id").cast("string")))
    cutoff = smallest_cutoffs(df, [("x", F.col("h"))], {"x": k}, 5000 if known else None)["x"]
    assert df.where(F.col("h") <= cutoff).count() == k


def test_cutoffs_with_a_wrong_row_count_are_still_exact(spark):
    df = spark.range(5000).withColumn("h", cell_hash(1, "s", F.col("id").cast("string")))
    for claimed in (600, 100_000):
        cutoff = smallest_cutoffs(df, [("x", F.col("h"))], {"x": 500}, claimed)["x"]
        assert df.where(F.col("h") <= cutoff).count() == 500


def test_no_shuffle_of_the_table(spark):
    plan = corrupt.inject_anomalies(table(spark), ["id"], 0.3, seed=5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_compounding_through_every_number_type(spark):
    df = spark.range(60).select(
        "id", F.lit(5).cast("smallint").alias("s"), F.lit(7).alias("i"), F.lit("2.50").cast("decimal(12,2)").alias("d"),
        F.lit(1.5).cast("float").alias("f"), F.lit(3.0).alias("x"),
    )
    spoiled = corrupt.inject_outliers(df, 120, ["id"], seed=4, columns=["s", "i", "d", "f", "x"])
    assert spoiled.schema.fields[1:] and [f.dataType for f in spoiled.schema.fields] == [f.dataType for f in df.schema.fields]
    row = spoiled.agg(*[F.max(c).alias(c) for c in ("s", "i", "d", "f", "x")]).first()
    assert row.s == 2**15 - 1 and row.i == 2**31 - 1 and row.d == 9999999999 and row.f > 1e10 and row.x > 1e10
    powers = {r.x for r in spoiled.where("x <> 3.0").select("x").collect()}
    assert all(abs(math.log10(p / 3.0) - round(math.log10(p / 3.0))) < 1e-9 for p in powers)


def test_infinity_after_many_hits(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("x"))
    spoiled = corrupt.inject_outliers(df, 1500, ["id"], seed=4, columns=["x"])
    finite = spoiled.where("x > 1 AND x < double('inf')").count()
    infinite = spoiled.where("x = double('inf')").count()
    assert 120 < finite < 200 and 800 < infinite < 1000
    assert spoiled.where("x > 1 AND x < double('inf')").select("x").distinct().count() == finite
