from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluicebox import scratch
from sluicebox.functions import scalars
from sluicebox.operators import latest as L
from sluicebox.operators import metrics as M
from sluicebox.operators import buckets, ordering, profile, sinks
from sluicebox.plans import audit, maintained, model, views
from sluicebox.operators import rules as R
from sluicebox.operators.incremental import check_changed
from sluicebox.showcase import file_queries
from sluicebox.streaming.folders import check_folder
from sluicebox.streaming.keys import check_folder_keys

NOW = dt.datetime(2025, 1, 1)


def test_insert_if_absent(spark):
    existing = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5), (None, 5)], "k string, v int")
    rows = sorted(sinks.insert_if_absent(existing, new, ["k"]).collect(), key=str)
    assert sorted(map(tuple, rows), key=str) == sorted([("a", 1), ("b", 2), (None, 5), (None, 5)], key=str)


def test_upsert_stamps_changed_rows_only(spark):
    target = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", None)], "id int, name string, other string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(2, None), (3, "c")], "id int, name string")
    rows = {r.id: tuple(r)[1:] for r in sinks.upsert(target, changes, ["id"], NOW).collect()}
    assert rows == {1: ("a", "x", None), 2: (None, "y", NOW), 3: ("c", None, NOW)}
    assert sinks.upsert(target, changes, ["id"], NOW, insert=False).count() == 2


def test_upsert_refuses_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a")], "id int, name string")
    changes = spark.createDataFrame([(1, "b"), (1, "c")], "id int, name string")
    with pytest.raises(PySparkException, match="occurs twice"):
        sinks.upsert(target, changes, ["id"]).collect()


def model_tables(spark):
    tables = model.empty_tables(spark)
    tables["pipelines"] = model.as_table(spark.createDataFrame([("p1", "one"), ("p2", "two")], "id string, name string"), "pipelines")
    executions = [("e1", "p1"), ("e2", "p1"), ("e3", "p2")]
    tables["executions"] = model.as_table(spark.createDataFrame(executions, "id string, pipeline_id string"), "executions")
    results = [("v1", "e1", "r", "not_null", True), ("v2", "e3", "r", "not_null", True)]
    tables["validation_results"] = model.as_table(
        spark.createDataFrame(results, "id string, execution_id string, rule_name string, rule_type string, passed boolean"),
        "validation_results",
    )
    logs = [("l1", "e1", "m", "x"), ("l2", "e3", "m", "x"), ("l3", None, "m", "x")]
    tables["audit_logs"] = model.as_table(
        spark.createDataFrame(logs, "id string, execution_id string, module string, event string"), "audit_logs"
    )
    return tables


def test_delete_follows_the_foreign_keys(spark):
    tables = model_tables(spark)
    after = sinks.delete(tables, model.FOREIGN_KEYS, "pipelines", tables["pipelines"].where("name = 'one'"))
    ids = {name: sorted(r.id for r in df.collect()) for name, df in after.items()}
    assert ids["pipelines"] == ["p2"] and ids["executions"] == ["e3"] and ids["validation_results"] == ["v2"]
    assert ids["audit_logs"] == ["l1", "l2", "l3"]
    assert {r.id: r.execution_id for r in after["audit_logs"].collect()} == {"l1": None, "l2": "e3", "l3": None}
    assert sorted(r.id for r in tables["executions"].collect()) == ["e1", "e2", "e3"]


def test_defaults(spark):
    row = model_tables(spark)["executions"].first()
    assert row.status == "pending" and row.records_processed == 0 and row.metrics == "{}" and row.start_time is not None
    assert row.end_time is None
    kept = spark.createDataFrame([("e", "p", None)], "id string, pipeline_id string, status string")
    assert model.as_table(kept, "executions").first().status is None


@pytest.mark.parametrize("table", list(model.TABLES))
def test_model_tables_have_rules_that_run(spark, table):
    tables = model_tables(spark)
    results = model.validate_table(table, tables, "run", NOW).collect()
    assert results and all(r.passed for r in results)
    assert model.as_table(tables[table], table).schema.names == model.TABLES[table].names


def test_model_rules_find_bad_rows(spark):
    tables = model_tables(spark)
    rows = [("e9", "nope", "lost", NOW, NOW - dt.timedelta(days=1)), ("e9", "p1", "failed", NOW, None)]
    bad = spark.createDataFrame(rows, "id string, pipeline_id string, status string, start_time timestamp, end_time timestamp")
    tables["executions"] = model.as_table(bad, "executions")
    failed = {r.rule_name for r in model.validate_table("executions", tables, "run", NOW).collect() if not r.passed}
    assert failed == {"id_unique", "pipeline_id_references", "status_accepted", "end_time_after_start_time"}


def test_first_rows_are_inserted_once(spark):
    tables = model.empty_tables(spark)
    pipelines = tables["pipelines"].unionByName(model.new_pipelines(spark, tables["pipelines"]))
    assert model.new_pipelines(spark, pipelines).count() == 0
    scenarios = model.new_scenarios(spark, tables["attack_scenarios"])
    assert sorted(r.name for r in scenarios.collect()) == ["data_poisoning_test", "sql_injection_basic"]
    executions = model.new_execution(pipelines)
    execution = executions.first()
    assert (execution.status, execution.records_processed, execution.records_failed) == ("completed", 1000, 50)
    assert json.loads(execution.metrics) == {"duration_seconds": 45.2, "throughput": 22.2}
    result = model.new_validation(executions).first()
    assert (result.rule_name, result.passed, result.failed_count) == ("email_not_null", False, 50)


def summary(spark, rows):
    pipelines = spark.createDataFrame([("p", "name")], "id string, name string")
    executions = spark.createDataFrame(
        rows, "id string, start_time timestamp, end_time timestamp, records_processed int, records_failed int"
    ).select("*", *[F.lit(v).alias(c) for c, v in {"pipeline_id": "p", "status": "completed", "metrics": "{}", "error_message": ""}.items()])
    return {r.id: r for r in views.execution_summary(executions, pipelines).collect()}


def test_execution_summary(spark):
    start = dt.datetime(2025, 1, 1)
    rows = [
        ("a", start, start + dt.timedelta(seconds=45.2), 1000, 50), ("b", start, None, 3, 1), ("c", start, start, 0, 0),
        ("d", start, start, None, 7), ("e", start, start, 800, 1),
    ]
    found = summary(spark, rows)
    assert found["a"].duration_seconds == 45.2 and found["b"].duration_seconds is None
    rates = {k: float(r.failure_rate_percent) for k, r in found.items()}
    assert rates == {"a": 5.0, "b": 33.33, "c": 0.0, "d": 0.0, "e": 0.13}


def test_posture_skips_rows_without_attempts(spark):
    rows = [("x", 10, 5, 1, "80.00", "1.50", NOW), ("x", 3, 1, 0, None, "2.00", None), ("x", 0, 0, 9, "1.00", "9.00", NOW)]
    df = spark.createDataFrame(
        rows, "attack_type string, attempts_total int, attempts_detected int, attempts_successful int, s string, m string, start_time timestamp"
    ).select("*", F.col("s").cast("decimal(5,2)").alias("security_score"), F.col("m").cast("decimal(10,2)").alias("mttd_avg_ms"))
    row = views.security_posture(df).first()
    assert row.total_simulations == 2 and float(row.avg_security_score) == 80.0 and float(row.avg_mttd_ms) == 1.75
    assert float(row.avg_detection_rate) == 41.67 and row.total_successful_attacks == 1 and row.last_simulation_date == NOW


def test_duration_function(spark):
    start = dt.datetime(2025, 1, 1)
    executions = spark.createDataFrame([("a", start, start + dt.timedelta(seconds=45.2)), ("b", start, None)], "id string, start_time timestamp, end_time timestamp")
    ids = spark.createDataFrame([("a",), ("b",), ("zzz",)], "id string")
    found = {r.id: r.duration for r in views.execution_duration(executions, ids).collect()}
    assert found == {"a": dt.timedelta(seconds=45.2), "b": None, "zzz": None}


def test_duration_ignores_the_time_zone(spark):
    """The clocks change between the two times in many zones; local times still lie a day apart."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-09 12:00:00' s, timestamp_ntz'2024-03-10 12:00:00.25' e")
        assert df.select(scalars.seconds_between("s", "e")).first()[0] == 86400.25
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scalars(spark):
    df = spark.createDataFrame([(" a ", [], 2.5, '{"k": {"n": 4}}'), (None, [1, 2], 3.5, "not json")], "s string, a array<int>, d double, j string")
    a, b = df.select(
        scalars.trimmed_length("s"), scalars.array_length("a"), scalars.money_round("d", 0).cast("int"),
        scalars.json_value("j", "$.k.n", "int"), F.round(F.lit("-2.345").cast("decimal(6,3)"), 2).cast("string"),
    ).collect()
    assert tuple(a) == (1, None, 2, 4, "-2.35") and tuple(b) == (None, 2, 4, None, "-2.35")


def test_latest(spark):
    rows = [(1, "m", 5.0, NOW), (2, "m", 6.0, NOW), (3, "n", 7.0, None)]
    df = spark.createDataFrame(rows, "id int, metric_name string, value double, timestamp timestamp")
    assert sorted((r.metric_name, r.id) for r in M.latest_metrics(df).collect()) == [("m", 2), ("n", 3)]
    assert L.latest(df, ["timestamp"]).first().id == 3


def test_throughput(spark):
    df = spark.createDataFrame([(1000, 45.2), (5, 0.0)], "n int, s double")
    assert [r[0] for r in df.select(F.round(M.throughput("n", "s"), 2)).collect()] == [22.12, None]
    assert json.loads(df.select(M.run_metrics("n", "s")).first()[0]) == {"duration_seconds": 45.2, "throughput": 22.12}


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [1.0] * 50 + [9.0] * 50, list(range(101)), [-3.5, 0.0, 2.25, 2.25, 1e9]])
def test_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("g", None)], "g string, v double")
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    row = ordering.percentiles(df, "g", "v", points).where("g = 'g'").first()
    for name, p in points.items():
        assert row[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_percentiles_of_a_group_that_spans_partitions(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 10007).cast("double").alias("v"),
    )
    found = {r.g: (r.p50, r.p99) for r in ordering.percentiles(df, "g", "v", {"p50": 0.5, "p99": 0.99}).collect()}
    expected = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.99))).alias("p")).collect()
    assert len(found) == 51 == len(expected)
    for r in expected:
        assert found[r.g] == pytest.approx(tuple(r.p), rel=1e-12)


def test_rollup_keeps_the_group_without_a_name(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "g string, v double")
    rows = {r.g: (r.samples, r["mean"], r.p50) for r in M.latency_rollup(df, "g", "v").collect()}
    assert rows == {None: (2, 2.0, 2.0), "a": (1, 5.0, 5.0)}


def test_row_index_with_ties_and_copies(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.lit("same").alias("x"))
    indexed = ordering.row_index(df, ["k"])
    assert sorted(r.row_index for r in indexed.collect()) == list(range(5000))
    assert indexed.where("k = 0").agg(F.max("row_index")).first()[0] == 2499
    assert ordering.row_index(df.limit(0), ["k"]).count() == 0


def test_pages(spark):
    numbered = ordering.pages(spark.range(25), ["id"], 10)
    assert sorted((r.page_id, r["count"]) for r in numbered.groupBy("page_id").count().collect()) == [(0, 10), (1, 10), (2, 5)]
    assert [r.id for r in ordering.page(spark.range(25), ["id"], 10, 2).collect()] == [20, 21, 22, 23, 24]


def test_a_page_far_back(spark):
    df = spark.range(300_000 * 10 + 25).select(F.lit(1).alias("tie"), F.col("id"))
    assert [r.id for r in ordering.page(df, ["tie", "id"], 10, 300_000).collect()] == list(range(3_000_000, 3_000_010))
    assert [r.id for r in ordering.page(df, [F.desc("id")], 10, 300_002).collect()] == [4, 3, 2, 1, 0]
    assert ordering.page(df, ["id"], 10_000, 300_000).collect() == []
    assert ordering.page(df, ["id"], 0, 1).collect() == []


def test_null_keys_are_added_by_upsert(spark):
    target = spark.createDataFrame([(1, "a", None), (None, "b", None)], "id int, v string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(None, "x"), (None, "y"), (1, "z")], "id int, v string")
    rows = sinks.upsert(target, changes, ["id"], NOW).collect()
    assert sorted((str(r.id), r.v, r.updated_at is not None) for r in rows) == [
        ("1", "z", True), ("None", "b", False), ("None", "x", True), ("None", "y", True),
    ]
    assert sinks.upsert(target, changes, ["id"], NOW, insert=False).count() == 2


def test_delete_passes_every_key_on(spark):
    from sluicebox.operators.sinks import ForeignKey, delete

    tables = {
        "a": spark.createDataFrame([(1,), (2,)], "id int"),
        "b": spark.createDataFrame([(10, "x", 1), (None, "y", 1), (30, "z", 2)], "id int, code string, a int"),
        "c": spark.createDataFrame([(10,), (30,), (None,)], "b int"),
        "d": spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "b string"),
    }
    links = [ForeignKey("b", "a", "a"), ForeignKey("c", "b", "b"), ForeignKey("d", "b", "b", key="code", on_delete="set_null")]
    left = delete(tables, links, "a", spark.createDataFrame([(1,)], "id int"))
    assert [tuple(r) for r in left["b"].collect()] == [(30, "z", 2)]
    assert sorted(str(r.b) for r in left["c"].collect()) == ["30", "None"]
    assert sorted(str(r.b) for r in left["d"].collect()) == ["None", "None", "None", "z"]


def test_daily_stores_have_few_files(spark, tmp_path):
    from sluicebox.operators.metrics import write_metrics

    days = spark.range(0, 6000, 1, 20).select(
        F.col("id").cast("string").alias("id"), F.lit("m").alias("metric_name"),
        F.timestamp_seconds(F.col("id") % 30 * 86_400).alias("timestamp"),
    )
    write_metrics(days, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("*/*.parquet"))) <= 40
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6000


def test_keys_with_separators_differ(spark):
    from sluicebox.functions.draws import key_text

    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a\\", "|"), ("a", "\\|"), (None, "x"), ("~", "x"), ("\\0", "x")], "p string, q string")
    assert df.select(key_text(["p", "q"])).distinct().count() == 7


def test_profile(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b double, c string")
    rows = {r.column: (r.rows, r.nulls, r.maximum) for r in profile.profile(df).collect()}
    assert rows == {"a": (2, 0, "2"), "b": (2, 2, None), "c": (2, 1, None)}
    wide = spark.createDataFrame([(2**53 + 1, float("nan")), (2**53, 2.5)], "a bigint, b double")
    assert [r.maximum for r in profile.profile(wide).collect()] == [str(2**53 + 1), "2.5"]
    assert profile.null_cells(df).first()[0] == 3
    assert sorted(tuple(r) for r in profile.labels(df, ["a"]).collect()) == [("a", "1", 1), ("a", "2", 1)]


def test_bag_union_of_nothing(spark):
    assert sinks.bag_union([spark.range(0), spark.range(2), spark.range(2)]).count() == 4
    with pytest.raises(ValueError):
        sinks.bag_union([])


def test_secrets_are_dropped(spark):
    config = {"host": "h", "password": "p", "DB_PassWord": "q", "user": "u"}
    assert audit.without_secrets(config) == {"host": "h", "user": "u"}


def test_audited_extraction(spark, tmp_path):
    logs = str(tmp_path / "logs")
    n = audit.audited_extraction(
        spark, "csv", lambda: spark.range(12), lambda df: df.write.parquet(str(tmp_path / "out")),
        lambda row: audit.write_audit(row, logs), config={"password": "x", "path": "y"},
    )
    assert n == 12

    def broken():
        raise OSError("no such source")

    with pytest.raises(OSError):
        audit.audited_extraction(spark, "csv", broken, lambda df: None, lambda row: audit.write_audit(row, logs))
    found = {r.level: json.loads(r.context) for r in audit.find_audit(spark.read.parquet(logs), module="ingestion").collect()}
    assert found["INFO"]["records"] == 12 and found["ERROR"]["records"] == 0 and "password" not in str(found)
    assert audit.find_audit(spark.read.parquet(logs), level="ERROR").count() == 1


def test_stream_resumes_and_repeats_safely(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.mode("append").option("header", True).csv(source)
    rules = [R.min_value("id", 5)]
    options = {"options": {"header": True}}
    first = check_folder(spark, source, "id bigint", rules, out, progress, **options)
    assert first.agg(F.sum("records_processed")).first()[0] == 30
    spark.range(100, 105).write.mode("append").option("header", True).csv(source)
    second = check_folder(spark, source, "id bigint", rules, out, progress, **options)
    assert second.agg(F.sum("records_processed"), F.sum("failed_count")).first()[:] == (35, 5)


def test_stream_keys_hold_across_pieces_and_replays(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "id bigint, price double, name string"
    pieces = [[(1, 0.5, "a"), (2, 0.5, None)], [(1, -0.0, "a"), (3, 0.0, "b")], [(1, 7.0, "a"), (None, 8.0, "c"), (9, 9.0, None)]]
    parents = spark.createDataFrame([("a",), ("x",), (None,)], "name string")
    rules = [R.unique("id"), R.unique("price"), R.references("name", parents, "name"), R.unique("id", "name", name="pair")]
    options = {"options": {"header": True}}

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").option("header", True).csv(source)

    def check():
        return {r.rule_name: r.failed_count for r in check_folder_keys(spark, source, schema, rules, out, progress, **options).collect()}

    def batch(rows):
        return {r.rule_name: r.failed_count for r in R.failed_counts(spark.createDataFrame(rows, schema), rules).collect()}

    for i, piece in enumerate(pieces):
        add(piece)
        assert check() == batch(sum(pieces[: i + 1], []))
    before = check()
    # As if the application had died after the last piece was written and before it was recorded.
    commits = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "progress" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    assert check() == before == {"id_unique": 3, "price_unique": 4, "name_references": 2, "pair": 3}
    assert sorted(p.name for p in commits[-1].parent.glob("[0-9]*"))[-1] == commits[-1].name


def test_stream_keys_stand_in_few_buckets_on_disk(spark, tmp_path):
    """A piece opens and saves every bucket, so their number is that of the cores' use and not of the shuffle partitions."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame([(i % 40,) for i in range(60)], "id bigint").repartition(3).write.csv(source)
    names = ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "70")
    try:
        rows = check_folder_keys(spark, source, "id bigint", [R.unique("id")], out, progress).collect()
        assert spark.conf.get(names[0]) == "70" and spark.conf.get(names[1]) == before[names[1]]
    finally:
        spark.conf.set(names[0], before[names[0]])
    assert [tuple(r) for r in rows] == [("id_unique", "unique", 40)]
    buckets = list((tmp_path / "progress" / "state" / "0").glob("[0-9]*"))
    assert len(buckets) == min(70, 2 * spark.sparkContext.defaultParallelism)
    assert "RocksDB" in (tmp_path / "progress" / "offsets" / "0").read_text()


def test_stream_files_have_a_bounded_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "ROWS_PER_DOCUMENT", 10)
    monkeypatch.setattr(file_queries, "STREAM_FILES", 4)
    for rows, files in ((0, 0), (7, 1), (15, 2), (95, 4)):
        orders = spark.range(rows).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("o_orderkey"), F.col("id").alias("o_custkey"))
        orders.write.parquet(str(tmp_path / str(rows) / "orders.parquet"))
        path = file_queries._csv_stream(spark, str(tmp_path / str(rows))).removeprefix("file:")
        found = spark.read.schema(orders.schema).option("header", True).csv(path)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, orders.collect()), key=repr)
        if rows:
            assert len(list(Path(path).glob("part-*"))) == files


def test_stream_keys_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    found = check_folder_keys(spark, str(tmp_path / "in"), "id bigint", [R.unique("id")], str(tmp_path / "out"), str(tmp_path / "progress"))
    assert [tuple(r) for r in found.collect()] == [("id_unique", "unique", 0)]


def test_changed_files_only_are_checked_again(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    parents = spark.range(50)
    rules = [R.min_value("v", 3), R.unique("id"), R.references("id", parents, "id")]

    def put(piece, first, n):
        rows = spark.range(first, first + n).select("id", (F.col("id") % 10).alias("v")).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{folder}/piece={piece}")

    def check(rules=rules):
        found = check_changed(spark, str(folder), rules, store)
        whole = R.failed_counts(spark.read.parquet(str(folder)), rules)
        assert sorted(map(tuple, found.results.collect())) == sorted(map(tuple, whole.collect()))
        counters = found.counters.first()
        assert counters.records_processed == spark.read.parquet(str(folder)).count()
        assert counters.records_failed == spark.read.parquet(str(folder)).where("v < 3").count()
        return found.files, found.files_read

    put(0, 0, 20)
    put("a b", 20, 20)
    put(2, 40, 20)
    assert check() == (3, 3)
    assert check() == (3, 0)
    put(3, 10, 5)  # added: five keys a second time
    assert check() == (4, 1)
    put(2, 100, 7)  # replaced
    assert check() == (4, 1)
    for file in list((folder / "piece=0").iterdir()):
        file.unlink()  # removed: the repeated keys are single again
    assert check() == (3, 0)
    assert check([R.min_value("v", 3, name="other"), R.unique("v"), R.min_value("v", 3)]) == (3, 3)  # other rules
    assert check() == (3, 0)
    assert {r.rule_name: r.failed_count for r in check_changed(spark, str(folder), rules, store).results.collect()}["id_unique"] == 0


def test_changed_files_left_by_a_lost_run(spark, tmp_path, monkeypatch):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.range(10).coalesce(1).write.parquet(folder)
    rules = [R.unique("id"), R.min_value("id", 4)]
    from sluicebox.operators import incremental

    def lost(df, label):
        if label == "fresh":
            raise RuntimeError("lost")
        return scratch.written(df, label)

    monkeypatch.setattr(incremental, "written", lost)
    with pytest.raises(RuntimeError):
        check_changed(spark, folder, rules, store)
    monkeypatch.setattr(incremental, "written", scratch.written)
    found = check_changed(spark, folder, rules, store)
    assert {r.rule_name: r.failed_count for r in found.results.collect()} == {"id_unique": 0, "id_min": 4}
    assert found.files_read == 1 and found.counters.first()[:] == (10, 4)


def rows_read(df):
    """Rows that the file scan of a plan without shuffles gives to the rest of it, and the result's rows."""
    plan = df._jdf.queryExecution().executedPlan()
    found = len(plan.executeCollect())
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value(), found


def test_audit_lookup_reads_few_rows(spark, tmp_path):
    logs = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") * 2 + 1_700_000_000).alias("timestamp"), F.md5((F.col("id") % 500).cast("string")).alias("correlation_id"),
        F.lit("INFO").alias("level"), F.lit("m").alias("module"), "id",
    )
    audit.write_audit(logs, str(tmp_path / "logs"))
    stored = spark.read.parquet(str(tmp_path / "logs"))
    key = logs.where("id = 7").first()["correlation_id"]
    read, found = rows_read(audit.find_audit(stored, correlation_id=key))
    assert found == 120 and read < 6_000
    # Within the range of ids, but in no file: the bloom filters pass over all of them.
    assert rows_read(audit.find_audit(stored, correlation_id=key[:-1] + "x")) == (0, 0)


def test_latency_sketches_add_up(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = spark.range(40_000).select(
        F.timestamp_seconds(F.col("id") * 10 + 1_700_000_000).alias("at"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"),
        F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.lit("NaN").cast("double")).otherwise(F.pow(F.rand(1), 3)).alias("v"),
    )
    rows = scratch.written(rows)
    M.write_latency_sketches(rows.where("g = 'hot'"), path, ["g"], "v", "at")
    M.write_latency_sketches(rows.where("g <> 'hot'"), path, ["g"], "v", "at")
    found = M.sketched_latency(spark.read.parquet(path), ["g"])
    known = rows.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    exact = {r.g: r for r in known.collect()}
    for r in found.collect():
        e = exact[r.g]
        assert (r.samples, r.minimum, r.maximum) == (e.n, e.low, e.high) and r.mean == pytest.approx(e.mean)
    errors = M.rank_errors(rows, "g", "v", found).collect()
    assert len(errors) == 2 and all(e[c] <= 3 * M.sketch_rank_error() for e in errors for c in M.LATENCY_POINTS)
    assert M.sketched_latency(spark.read.parquet(path), []).first()["samples"] == sum(e.n for e in exact.values())


def test_few_samples_have_exact_ranks(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = spark.createDataFrame([("a", float(i), NOW) for i in range(1, 101)] + [("b", None, NOW)], "g string, v double, at timestamp")
    M.write_latency_sketches(rows, path, ["g"], "v", "at")
    (only,) = M.sketched_latency(spark.read.parquet(path), ["g"]).collect()
    assert only.asDict() == {"g": "a", "samples": 100, "mean": 50.5, "minimum": 1.0, "maximum": 100.0, "p50": 50.0, "p95": 95.0, "p99": 99.0}


def test_heavy_labels_are_all_found(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id")))
    late = F.when(F.col("id") >= 29_000, "late").otherwise(F.col("id").cast("string"))  # in the last tasks only
    df = scratch.written(spark.range(30_000).select(hot.alias("a"), late.alias("b.c"), (F.col("id") % 7).alias("d")))
    found = sorted((tuple(r) for r in profile.heavy_labels(df, ["a", "b.c", "d"], 0.03).collect()), key=str)
    whole = profile.labels(df, ["a", "b.c", "d"]).where("rows >= 900")
    assert found == sorted((tuple(r) for r in whole.collect()), key=str)
    assert ("a", "hot", 10_000) in found and ("b.c", "late", 1_000) in found and [v for c, v, _ in found if c == "a" and v is None]
    assert profile.heavy_labels(df.limit(0), ["a"], 0.5).count() == 0
    with pytest.raises(ValueError):
        profile.heavy_labels(df, ["a"], 0)


def test_summaries_bound_their_error():
    import pandas as pd

    rng, size = np.random.default_rng(3), 20
    values = np.concatenate([rng.integers(0, 5000, 20_000), np.full(2_500, 7)])
    rng.shuffle(values)
    kept, missed = pd.Series(dtype="int64"), 0
    for part in np.array_split(values, 30):
        kept, error = profile._fewest(kept, pd.Series(part.astype(str)).value_counts(dropna=False), size)
        missed += error
    exact = pd.Series(values.astype(str)).value_counts()
    assert missed <= len(values) / (size + 1) and "7" in kept.index and len(kept) <= size
    assert all(n - missed <= kept.get(v, 0) <= n for v, n in exact.items())


def test_posture_follows_changes(spark):
    schema = (
        "id int, attack_type string, start_time timestamp, attempts_total bigint, attempts_detected bigint, attempts_successful bigint, "
        "mttd_avg_ms decimal(10,2), security_score decimal(5,2)"
    )
    from decimal import Decimal as D

    def row(i, kind, day, total=10, detected=3, won=1, mttd="1.25", score="50.00"):
        when = dt.datetime(2025, 1, day) if day else None
        return (i, kind, when, total, detected, won, D(mttd) if mttd else None, D(score) if score else None)

    first = [row(1, "a", 5), row(2, "a", 9, detected=7), row(3, "b", 2, mttd=None), row(4, None, 3), row(5, "c", 4), row(6, "d", 4, total=0), row(7, "e", None)]
    then = [row(1, "a", 5, score="0.01"), row(3, "b", 8, mttd="3.33"), row(8, "b", 1), row(4, None, 1), row(6, "d", 4, total=3), row(9, "n", 6, won=None), row(7, "e", 2)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    view = lambda df: sorted(map(tuple, df.collect()), key=str)
    state = maintained.posture_state(frame(first))
    assert view(maintained.posture_of(state)) == view(views.security_posture(frame(first)))
    gone = [r for r in first if r not in then]
    new = [r for r in then if r not in first]
    changed = maintained.changed_posture(state, frame(gone), frame(new), frame(then))
    assert view(maintained.posture_of(changed)) == view(views.security_posture(frame(then)))
    same = maintained.changed_posture(changed, frame([]), frame([]), frame([]))  # without a lost maximum the table is not read
    assert view(maintained.posture_of(same)) == view(views.security_posture(frame(then)))


def test_scratch_is_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod({"spark.checkpoint.dir": "hdfs:///shared/", "spark.sql.warehouse.dir": "hdfs:///w"}.get)

    assert scratch.scratch_root(Fake()) == "hdfs:///shared"
    Fake.conf.get = staticmethod(lambda name, default=None: {"spark.sql.warehouse.dir": "hdfs:///w"}.get(name, default))
    assert scratch.scratch_root(Fake()) == "hdfs:///w/_scratch"


def test_scratch_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_made", {})
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: str(tmp_path))
    scratch.written(spark.range(3))
    assert len(list(tmp_path.iterdir())) == 1
    assert scratch.drop_scratch(spark) == 1 and not list(tmp_path.iterdir())
    assert scratch.drop_scratch(spark) == 0


def test_bucketed_changes_touch_only_their_buckets(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(i, f"v{i}") for i in range(500)]
    buckets.write_bucketed(spark.createDataFrame(rows, "id bigint, v string"), str(path), ["id"], 16)

    def files():
        return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}

    before = files()
    touched = buckets.upsert_bucketed(spark, str(path), spark.createDataFrame([(3, "x"), (900, "y"), (None, "z")], "id int, v string"), ["id"])
    after = files()
    same = {f for f in before if f"={touched[0]}/" not in str(f) and int(f.parent.name.split("=")[1]) not in touched}
    assert 0 < len(touched) <= 3 and len(same) >= 13 and all(after[f] == before[f] for f in same)
    expected = [(i, "x" if i == 3 else v) for i, v in rows] + [(900, "y"), (None, "z")]
    read = lambda: sorted(map(tuple, buckets.read_bucketed(spark, str(path)).collect()), key=repr)
    assert read() == sorted(expected, key=repr)
    assert buckets.insert_bucketed(spark, str(path), spark.createDataFrame([(3, "no"), (901, "w")], "id bigint, v string"), ["id"])
    everything = buckets.read_bucketed(spark, str(path)).where("id % 16 < 15 AND id < 800")
    buckets.delete_bucketed(spark, str(path), everything.select("id"), ["id"])
    left = [r for r in [*expected, (901, "w")] if r[0] is None or r[0] % 16 == 15 or r[0] >= 800]
    assert read() == sorted(left, key=repr)
    assert buckets.upsert_bucketed(spark, str(path), spark.createDataFrame([], "id bigint, v string"), ["id"]) == []
    with pytest.raises(Exception, match="occurs twice"):
        buckets.upsert_bucketed(spark, str(path), spark.createDataFrame([(1, "a"), (1, "b")], "id bigint, v string"), ["id"])
    assert read() == sorted(left, key=repr)
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="no table in buckets"):
        buckets.read_bucketed(spark, str(tmp_path / "plain"))


def test_small_changes_do_not_shuffle_the_target(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    changes = spark.createDataFrame([(5, 0), (200_000, 1)], "id bigint, v bigint")
    for new in (sinks.upsert(target, changes, ["id"], stamp=None), sinks.insert_if_absent(target, changes, ["id"])):
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "FullOuter" not in plan
        assert new.count() == 100_001
