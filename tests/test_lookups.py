from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluicebox.operators import label_index as I
from sluicebox.sources.bounds import page_bounds, page_conditions


def scanned(df):
    """Rows of the result, and rows that its file scans of stored rows gave."""
    plan = df._jdf.queryExecution().executedPlan()
    found = len(plan.executeCollect())
    leaves = plan.executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName()]
    return found, sum(s.metrics().apply("numOutputRows").value() for s in scans)


def test_entries_of_labels(spark):
    texts = ['{"a":1,"b":{"c":"x","d":{"e":true,"f":{"g":2}}},"l":[1,2]}', "{}", "", None, "not json", '{"n":null,"o":{}}', '{"s":"{no"}']
    df = spark.createDataFrame([(t,) for t in texts], "labels string")
    found = [r.e and {e.path: e.value for e in r.e} for r in df.select(I.label_entries("labels").alias("e")).collect()]
    assert found[0] == {
        "a": "1", "b": '{"c":"x","d":{"e":true,"f":{"g":2}}}', "b.c": "x", "b.d": '{"e":true,"f":{"g":2}}', "b.d.e": "true", "b.d.f": '{"g":2}', "l": "[1,2]"}
    assert not any(found[1:5]) and found[5] == {"o": "{}"} and found[6] == {"s": "{no"}


def test_index_finds_all_and_reads_few(spark, tmp_path):
    path = str(tmp_path / "labelled")
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit('{"hot":"yes","run":0}')).otherwise(
            F.format_string('{"run":%d,"at":{"zone":"z%d"},"long":"%s"}', F.col("id") % 500, F.col("id") % 7, F.repeat(F.lit("x"), 300))).alias("labels"),
        F.lit("clash").alias("path"), F.lit("clash").alias("value"))
    I.write_indexed(rows, path, "labels", "first", parts=200)
    found, read = scanned(I.find_labelled(spark, path, "labels", {"run": 41}))
    assert found == sum(i % 500 == 41 and i % 3 > 0 for i in range(20_000)) and read < 2_000
    both = I.find_labelled(spark, path, "labels", {"run": 41, "at.zone": "z3"})
    assert sorted(r.id for r in both.collect()) == [i for i in range(20_000) if i % 500 == 41 and i % 7 == 3 and i % 3]
    assert both.columns == rows.columns
    assert I.find_labelled(spark, path, "labels", {"hot": "yes"}).count() == 6_667
    assert I.find_labelled(spark, path, "labels", {"long": "x" * 300}).count() == 13_333
    assert scanned(I.find_labelled(spark, path, "labels", {"run": "none"})) == (0, 0)


def test_index_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "labelled")
    df = spark.createDataFrame([(1, '{"k":"a"}'), (2, '{"k":"b"}'), (2, '{"k":"b"}'), (3, None), (4, "broken")], "id int, labels string")
    I.write_indexed(df, path, "labels", "one", parts=4)
    I.write_indexed(df.where("id = 2"), path, "labels", "two", parts=2)
    assert I.find_labelled(spark, path, "labels", {"k": "b"}).count() == 4
    I.write_indexed(df.where("id <> 2"), path, "labels", "one", parts=4)
    assert I.find_labelled(spark, path, "labels", {"k": "b"}).count() == 2
    assert [tuple(r) for r in I.label_counts(spark, path, {"k": "b"}).collect()] == [("k", "b", 2)]
    assert spark.read.parquet(f"{path}/rows").count() == 5
    empty = str(tmp_path / "empty")
    I.write_indexed(df.limit(0), empty, "labels", "none")
    with pytest.raises(ValueError):
        I.write_indexed(df, path, "labels", "a/b")
    with pytest.raises(ValueError):
        I.find_labelled(spark, path, "labels", {})


def plain_bounds(keys, size):
    keys = sorted(k for k in keys if k is not None)
    starts, place = [], 0
    while place < len(keys):
        starts.append((keys[place], place))
        end = (place // size + 1) * size  # the next opening; a page starts with the first key that begins there or later
        while end < len(keys) and keys[end] == keys[end - 1]:
            end += 1
        place = end
    return [(s, first, (starts[i + 1][1] if i + 1 < len(starts) else len(keys)) - first) for i, (s, first) in enumerate(starts)]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_bounds_of_skewed_keys(spark, size):
    draw = random.Random(3)
    wide = [draw.randrange(-(2**63), 2**63) for _ in range(200)] + [-(2**63), 2**63 - 1]
    near = [int(draw.paretovariate(0.6)) for _ in range(500)] + [5] * 300 + [None] * 20
    for keys in (wide, near, [7] * 50, list(range(100)), [], [None]):
        df = spark.createDataFrame([(k, "x") for k in keys], "k bigint, page_id string").repartition(5)
        bounds = page_bounds(df, "k", size)
        found = sorted(bounds.collect(), key=lambda r: r.page_id)
        expected = plain_bounds(keys, size)
        assert [(r.first_row, r.n_rows) for r in found] == [(first, n) for _, first, n in expected]
        assert [r.page_id for r in found] == list(range(len(found))) and [r.high for r in found] == [r.low for r in found[1:]] + [None] * bool(found)
        previous = None
        for r, (start, _, _) in zip(found, expected):
            assert r.low <= start and (previous is None or r.low > previous)
            previous = max(k for k in keys if k is not None and (r.high is None or k < r.high))


def test_conditions_hold_for_every_row_once(spark):
    df = spark.createDataFrame([(k,) for k in [None, 1, 1, 2, 50, 51, 52, 53, 1000]], "k bigint")
    conditions = page_conditions(page_bounds(df, "k", 3), "k")
    counts = [df.where(c).count() for c in conditions]
    assert sum(counts) == 9 and counts == [4, 3, 2]
    assert page_conditions(page_bounds(df.where("k = 1"), "k", 5), "k") == ["(1 = 1) OR k IS NULL"]
