from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluicebox.operators import rules as R
from sluicebox.operators import skew

NOW = dt.datetime(2025, 1, 1)


def failed(df, *rules):
    return {r.rule_name: r.failed_count for r in R.failed_counts(df, rules).collect()}


def count(df, rule):
    return failed(df, rule)[rule.name]


def test_null_is_only_a_violation_of_not_null(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None)], "s string, n double, a array<int>, t timestamp_ntz, u timestamp_ntz"
    )
    passing = [
        R.accepted_values("s", ["x"]), R.in_range("n", 0, 1), R.min_value("n", 0), R.ordered("t", "u"), R.not_blank("s"),
        R.not_empty("a"), R.max_length("s", 1), R.fits_decimal("n", 5, 2), R.uuid_text("s"), R.sum_at_most(["n"], "n"),
    ]
    assert set(failed(df, *passing).values()) == {0}
    assert count(df, R.not_null("s")) == 1


def test_row_rules(spark):
    df = spark.createDataFrame(
        [("a", 1.0, [1]), ("  ", 5.5, []), ("long", 1e9, [2, 3])], "s string, n double, a array<int>"
    )
    assert count(df, R.accepted_values("s", ["a", "long"])) == 1
    assert count(df, R.in_range("n", 0, 10)) == 1
    assert count(df, R.min_value("n", 2)) == 1
    assert count(df, R.not_blank("s")) == 1
    assert count(df, R.not_empty("a")) == 1
    assert count(df, R.max_length("s", 2)) == 1
    assert count(df, R.fits_decimal("n", 5, 2)) == 1


def test_decimal_rounds_extra_places(spark):
    df = spark.createDataFrame([(Decimal("999.994"),), (Decimal("999.996"),)], "n decimal(10,3)")
    assert count(df, R.fits_decimal("n", 5, 2)) == 1


def test_ordered_allows_equal_and_open_end(spark):
    rows = [(1, 1), (1, 2), (2, 1), (1, None), (None, 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert count(df, R.ordered("a", "b")) == 1


def test_sum_bound(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 2, 3), (None, 9, 1)], "a int, b int, t int")
    assert count(df, R.sum_at_most(["a", "b"], "t")) == 1


def test_unique_ignores_nulls_and_counts_all_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a")], "k int, s string")
    assert count(df, R.unique("k", "s")) == 3
    assert count(df, R.unique("k")) == 4


def test_references(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    child = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "fk int")
    assert count(child, R.references("fk", parent, "id")) == 2


def test_all_row_rules_share_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rules = [R.in_range("l_quantity", 0, i, f"r{i}") for i in range(20)]
    plan = R.failed_counts(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_empty_table(spark):
    df = spark.range(0)
    results = R.validate(df, [R.not_null("id"), R.unique("id")], "e", NOW).collect()
    assert [r.passed for r in results] == [True, True] and [r.failed_count for r in results] == [0, 0]


def test_result_shape_and_details(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "id int, email string")
    row = R.validate(df, [R.not_null("email"), R.not_null("id")], "run", NOW).where("NOT passed").first()
    assert row.rule_name == "email_not_null" and row.rule_type == "not_null" and row.failed_count == 5
    assert json.loads(row.failure_details) == [{"column": "email", "count": 5}]
    assert row.timestamp == NOW and row.execution_id == "run"
    each = R.failure_rows(df, [R.not_null("email")], ["id"], "run").collect()
    assert sorted((r.result_id, r.row, r.column, r.value) for r in each) == [(row.id, str(i), "email", None) for i in range(1, 10, 2)]


def test_rules_need_different_names(spark):
    rules = [R.in_range("id", 0, 5), R.in_range("id", 0, 4)]
    for use in (R.failed_counts, R.mark, lambda df, r: R.violations(df, r, ["id"]), lambda df, r: R.validate(df, r, "e", NOW)):
        with pytest.raises(ValueError, match="id_range"):
            use(spark.range(3), rules)


@pytest.mark.parametrize(("precision", "scale"), [(38, 18), (38, 0), (38, 38), (5, 2)])
def test_wide_decimals(spark, precision, scale):
    whole = 10 ** (precision - scale)
    values = [(Decimal(v),) for v in ("0.4", "-0.4", "0")] + [(None,)]
    df = spark.createDataFrame(values, "n decimal(38,18)").select("n", F.col("n").cast("double").alias("d"))
    assert count(df, R.fits_decimal("n", precision, scale)) == 0
    too_large = spark.sql(f"SELECT CAST('{whole}' AS DOUBLE) * 1.01D AS d, CAST('NaN' AS DOUBLE) AS e")
    assert count(too_large, R.fits_decimal("d", precision, scale)) == count(too_large, R.fits_decimal("e", precision, scale)) == 1


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Final Plan" in plan else plan
    return plan.count("FileScan")


def test_marking_reads_the_table_once_more_for_each_unique_rule(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    good, bad = R.split(lines, [R.in_range("l_quantity", 1, 45), R.unique("l_orderkey", "l_linenumber")])
    assert scans(bad.select("l_orderkey")) <= 2 and scans(good.select("l_orderkey")) <= 2
    good, _ = R.split(lines, [R.references("l_orderkey", orders, "o_orderkey")])
    assert scans(good.select("l_orderkey")) == 2


def test_config(spark):
    rules = R.rules_from_config('{"source": "x", "validations": ["not_null", "unique"]}', ["a", "b"])
    assert [r.name for r in rules] == ["a_not_null", "b_not_null", "a_unique", "b_unique"]
    (only,) = R.rules_from_config({"validations": [{"rule": "range", "args": ["a", 0, 9]}]}, [])
    assert only.kind == "range"
    (linked,) = R.rules_from_config({"validations": [{"rule": "references", "args": ["a", "parents", "id"]}]}, [], {"parents": spark.range(3)})
    assert linked.kind == "references" and linked.parent_columns == ("id",)
    with pytest.raises(ValueError, match="unknown table"):
        R.rules_from_config({"validations": [{"rule": "references", "args": ["a", "none", "id"]}]}, [])
    with pytest.raises(ValueError, match="unknown rule"):
        R.rules_from_config({"validations": ["nope"]}, ["a"])


def test_split_is_complete(spark):
    rows = [(1, "a", 1.0), (1, "a", 99.0), (2, None, 1.0), (3, "c", 2.0), (4, "d", 500.0), (None, "e", 1.0)]
    df = spark.createDataFrame(rows, "k int, s string, n double")
    parent = spark.createDataFrame([("a",), ("c",), ("d",)], "s string")
    rules = [R.unique("k"), R.in_range("n", 0, 100), R.references("s", parent, "s"), R.not_null("s")]
    good, bad = R.split(df, rules)
    assert sorted(r.k for r in good.collect()) == [3]
    broken = sorted((str(r.k), sorted(r[R.MARK])) for r in bad.collect())
    assert broken == [
        ("1", ["k_unique"]), ("1", ["k_unique"]), ("2", ["s_not_null"]), ("4", ["n_range"]), ("None", ["s_references"]),
    ]


def test_a_key_with_half_of_the_rows(spark):
    """Half of the rows share one key, and others have none."""
    k = F.when(F.col("id") % 2 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id") % 400)
    df = spark.range(6000).select(k.alias("k"), F.col("id").alias("v"))
    members = spark.range(100).select(F.col("id").alias("k")).union(spark.range(1).select(F.lit(-1)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flagged = skew.flag_keys(df, members, ["k"], "hit")
        assert flagged.count() == 6000 and flagged.select("v").distinct().count() == 6000
        assert flagged.where(F.col("hit") != F.coalesce(F.col("k") < 100, F.lit(False))).count() == 0
        marked = R.mark(df, [R.unique("k"), R.references("k", members, "k")])
        broken = {tuple(sorted(r[R.MARK])): r["count"] for r in marked.where("k = -1 OR k IS NULL").groupBy(R.MARK).count().collect()}
        assert broken == {("k_unique",): 3000, (): df.where("k IS NULL").count()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_run_counters(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, 4)], "a int, b int")
    row = R.run_counters(df, [R.not_null("a"), R.not_null("b")]).first()
    assert (row.records_processed, row.records_failed) == (3, 2)
    twice = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert R.run_counters(twice, [R.unique("id")]).first()[:] == (3, 2)
    assert R.run_counters(twice, [R.unique("id"), R.min_value("id", 2)]).first()[:] == (3, 2)


def test_write_split(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    R.write_split(df, [R.not_null("b")], str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert [r.a for r in found.where("quality = 'bad'").collect()] == [1]
    assert [r.a for r in found.where("quality = 'good'").collect()] == [2]
