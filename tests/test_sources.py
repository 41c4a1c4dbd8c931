from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluicebox.operators.sinks import write_csv
from sluicebox.scratch import scratch_path, written
from sluicebox.showcase import file_queries
from sluicebox.sources import blocks, documents, json_files, quoted
from sluicebox.sources.chunks import map_chunks, with_chunks
from sluicebox.sources.delimited import CsvOptions, merged_options, read_csv, read_csv_quarantined, require_clean
from sluicebox.sources.inventory import file_inventory, guarded, oversized_files, record_guard
from sluicebox.sources.jdbc import (
    KeyRange, bound_query, bounds_query, list_views, page_ranges, read_jdbc, source_options, tables_of, with_parameters,
)
from sluicebox.sources.json_files import read_json

SAMPLE = "id,name,value\n1,Alice,100\n2,Bob,200\n3,Charlie,300\n"


@pytest.fixture
def sample_csv(tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(SAMPLE, encoding="utf-8")
    return str(path)


def types(df):
    return dict(df.dtypes)


def test_csv_rows_and_columns(spark, sample_csv):
    df = read_csv(spark, sample_csv)
    assert df.count() == 3
    assert df.columns == ["id", "name", "value"]
    assert [r.name for r in df.orderBy("id").collect()] == ["Alice", "Bob", "Charlie"]
    assert types(df) == {"id": "bigint", "name": "string", "value": "bigint"}


def test_csv_usecols(spark, sample_csv):
    df = read_csv(spark, sample_csv, usecols=("id", "name"))
    assert df.columns == ["id", "name"]


def test_csv_unknown_column(spark, sample_csv):
    with pytest.raises(ValueError, match="not in the file"):
        read_csv(spark, sample_csv, usecols=("id", "nope"))


def test_csv_missing_file(spark, tmp_path):
    with pytest.raises(PySparkException):
        read_csv(spark, str(tmp_path / "missing.csv")).count()


def test_csv_call_options_override_config(spark, sample_csv):
    options = merged_options({"usecols": ["id"], "delimiter": ";"}, usecols=["name"], delimiter=",")
    assert options.usecols == ("name",)
    assert read_csv(spark, sample_csv, options).columns == ["name"]


def test_csv_nrows(spark, sample_csv):
    assert read_csv(spark, sample_csv, nrows=2).count() == 2


def test_csv_types_and_missing_words(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e,f,g\n1,1.5,True,x,2024-01-01,NA,1d\nN/A,inf,false,null,None,,2\n3,-1e3,,y,nan,NULL,3\n")
    df = read_csv(spark, str(path))
    assert types(df) == {
        "a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "double", "g": "string",
    }
    rows = df.collect()
    assert rows[1].a is None and rows[1].d is None and rows[1].e is None
    assert rows[1].b == float("inf")


def test_csv_large_integers_become_doubles(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a\n9223372036854775807\n9223372036854775808\n")
    assert types(read_csv(spark, str(path))) == {"a": "double"}


def test_csv_declared_types_and_dates(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,when\n007,2024-01-02 03:04:05\n")
    df = read_csv(spark, str(path), dtype={"a": "string"}, parse_dates=("when",))
    assert types(df) == {"a": "string", "when": "timestamp_ntz"}
    assert df.first().a == "007"


def test_csv_own_missing_words(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,missing\n2,NA\n")
    df = read_csv(spark, str(path), na_values=("missing",), keep_default_na=False)
    assert [r.b for r in df.collect()] == [None, "NA"]


def test_csv_quotes_line_breaks_and_accents(spark, tmp_path):
    rows = [(1, 'say "hi", twice'), (2, "two\nlines"), (3, "niño, à l'été")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "out")).collect()) == rows


def test_csv_empty_text_comes_back_as_null(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, ""), (2, "x")], "id bigint, text string"), str(tmp_path / "out"))
    assert [r.text for r in read_csv(spark, str(tmp_path / "out")).orderBy("id").collect()] == [None, "x"]


def test_csv_short_rows_are_padded_and_long_rows_raise(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,2\n4,5,6\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).collect()] == [(1, 2, None), (4, 5, 6)]
    path.write_text('a,b,c\n1,2,3\n4,5,6,"7,8"\n')
    with pytest.raises(PySparkException, match="too many fields"):
        read_csv(spark, str(path)).select("b").collect()


def test_csv_quarantine_keeps_good_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x,y"\n2,z,extra\n3\n')
    good, bad = read_csv_quarantined(spark, str(path))
    assert [tuple(r) for r in good.collect()] == [(1, "x,y"), (3, None)]
    assert [r.raw for r in bad.collect()] == ["2,z,extra"]
    with pytest.raises(ValueError, match="1 malformed"):
        require_clean(bad)


def test_csv_skiprows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("made by hand\nanother, line\n" + SAMPLE)
    df = read_csv(spark, str(path), skiprows=2, multi_line=False)
    assert df.columns == ["id", "name", "value"] and df.count() == 3


def test_csv_encoding_and_delimiter(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("id;name\n1;Muñoz\n".encode("latin-1"))
    df = read_csv(spark, str(path), CsvOptions(encoding="ISO-8859-1", delimiter=";"))
    assert df.first().name == "Muñoz"


RECORDS = ['1,"te\nx"', '2,"a ""q"" \r\n,"', '3,y"z', "", '4,"\n\n"', '5,"x"y,"p\n"""', '6,"open\nend']


@pytest.fixture
def block_size(spark):
    """Sets the size of input splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def size(n: int):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")

    yield size
    for name, value in before.items():
        spark.conf.set(name, value)


def test_quoted_records_do_not_depend_on_blocks(spark, tmp_path, block_size):
    """The block boundary stands at every byte once; the rows are those of one task reading the whole file."""
    raw = b"\xef\xbb\xbf" + "\n".join(RECORDS).encode()
    (tmp_path / "a.csv").write_bytes(raw)
    (tmp_path / "b.csv").write_bytes(b'1,"2\r\n3",4\r\n5,6,7\r\n')
    names = ("a", "b", "c")
    whole = sorted(map(tuple, read_csv(spark, str(tmp_path), names=names, header=False, infer=False, split=False).collect()), key=repr)
    assert len(whole) == 8
    for n in (4, 21, 10_000):
        block_size(n)
        rows = read_csv(spark, str(tmp_path), names=names, header=False, infer=False, split=True).collect()
        assert sorted(map(tuple, rows), key=repr) == whole, n


def test_quoted_blocks_may_end_at_any_byte():
    """One or two boundaries at every byte of a small file: a line belongs to the block that holds the byte before it."""
    raw = b"\xef\xbb\xbf" + "\n".join(RECORDS).encode()
    lines, at = [], 0
    for line in raw.split(b"\n"):
        lines.append((at, line))
        at += len(line) + 1

    def read(bounds: list[int]) -> list[tuple]:
        dealt = {bound: [] for bound in bounds}
        for place, line in lines:
            dealt[max(b for b in bounds if b < place or b == 0)].append(line)
        dealt = {b: found for b, found in dealt.items() if found}
        rows = []
        for bound, found in dealt.items():
            block = quoted._Quotes(b",")
            for line in found:
                block.add(line)
            rows.append({"file": "f", "block": bound, "key": bound} | dict(zip(quoted._SUMMARY, block.row(), strict=True)))
        starts = quoted._starts(rows, b",", 1)
        pieces: dict[int, list[bytes]] = {}
        for bound, found in dealt.items():
            block = quoted._Records(*starts[bound])
            out = [row for line in found for row in block.add(line)] + list(block.close())
            for position, whole, place, text in out:
                assert place == bound and (not whole or position not in pieces)
                pieces.setdefault(position, []).append(text)
        return [(position, b"\n".join(texts)) for position, texts in sorted(pieces.items())]

    expected = read([0])
    assert [position for position, _ in expected] == list(range(5))
    for first in range(1, len(raw) + 1):
        assert read([0, first]) == expected, first
        for second in range(first + 1, len(raw) + 1):
            assert read([0, first, second]) == expected, (first, second)


def test_one_quoted_file_has_more_tasks_than_files(spark, tmp_path, block_size):
    rows = [(i, f'line "{i}"\nnext, {i}') for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    block_size(20_000)
    found = read_csv(spark, str(tmp_path / "out"))  # larger than a block, so it is split without being asked to
    assert found.rdd.getNumPartitions() > 2
    assert sorted(map(tuple, found.collect())) == rows
    first = read_csv(spark, str(tmp_path / "out"), nrows=1500)
    assert sorted(map(tuple, first.collect())) == rows[:1500]
    skipped = read_csv(spark, str(tmp_path / "out"), skiprows=2000, header=False, names=("id", "text"))
    assert sorted(map(tuple, skipped.collect())) == rows[1999:]
    with pytest.raises(ValueError, match="cut at a byte"):
        read_csv(spark, str(tmp_path / "out"), encoding="utf-16", split=True, names=("id", "text"))


def test_split_files_report_long_rows(spark, tmp_path, block_size):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z,"ex\ntra"\n3\n')
    for n in (3, 9, 1000):
        block_size(n)
        good, bad = read_csv_quarantined(spark, str(path), split=True)
        assert sorted(tuple(r) for r in good.collect()) == [(1, "x\ny"), (3, None)]
        assert [r.raw for r in bad.collect()] == ['2,z,"ex\ntra"']
        with pytest.raises(PySparkException, match="too many fields"):
            read_csv(spark, str(path), split=True).select("b").collect()


def test_chunks_of_two(spark, sample_csv):
    chunked = with_chunks(read_csv(spark, sample_csv), 2)
    assert sorted(r["count"] for r in chunked.groupBy("_file", "chunk_id").count().collect()) == [1, 2]
    sizes = map_chunks(chunked, lambda p: p.head(1)[["chunk_id", "id"]], "chunk_id bigint, id bigint")
    assert sorted(tuple(r) for r in sizes.collect()) == [(0, 1), (1, 3)]


def test_chunks_follow_file_order_across_blocks(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("id\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scan = read_csv(spark, str(path), multi_line=False)
        assert scan.rdd.getNumPartitions() > 4
        chunked = with_chunks(scan, 300)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wrong = chunked.where((F.col("row_in_file") != F.col("id")) | (F.col("chunk_id") != F.floor(F.col("id") / 300)))
    assert chunked.count() == 20000 and wrong.count() == 0


def test_chunks_and_skipped_rows_without_broadcasts(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.csv").write_text("made for a test\n1,2,3,4\nid\n" + "\n".join(str(f * 10_000 + i) for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = read_csv(spark, str(tmp_path), multi_line=False, skiprows=2)
        assert sorted(r.id for r in kept.collect()) == [f * 10_000 + i for f in range(3) for i in range(5000)]
        chunked = with_chunks(read_csv(spark, str(tmp_path), multi_line=False, header=False, names=("a", "b", "c", "d"), infer=False), 300)
        numbers = chunked.where("row_in_file > 2").select(F.col("a").cast("int") % 10_000 + 3 != F.col("row_in_file"))
        assert chunked.count() == 15_009 and numbers.where(numbers[0]).count() == 0
        first = read_csv(spark, str(tmp_path), multi_line=False, header=False, names=("a", "b", "c", "d"), nrows=2)
        assert [tuple(r) for r in first.collect()] == [("made for a test", None, None, None), ("1", 2, 3, 4)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nrows_infers_from_the_rows_it_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "\n".join(f"{i},{i if i < 5 else 'x'}" for i in range(9)) + "\n")
    df = read_csv(spark, str(tmp_path / "a.csv"), nrows=5)
    assert dict(df.dtypes)["v"] == "bigint" and [r.v for r in df.collect()] == [0, 1, 2, 3, 4]
    assert dict(read_csv(spark, str(tmp_path / "a.csv"), nrows=6).dtypes)["v"] == "string"
    assert read_csv(spark, str(tmp_path / "a.csv"), nrows=0).count() == 0


@pytest.mark.parametrize("schema", [None, "x int", "x int, _corrupt_record string"])
def test_broken_json_objects_are_kept(spark, tmp_path, schema):
    (tmp_path / "good.json").write_text('{"k1":{"x":1},"k2":{"x":2}}')
    (tmp_path / "cut.json").write_text('{"k3":{"x":3},"k4":{"x"')
    (tmp_path / "list.json").write_text("[1]")
    rows = read_json(spark, str(tmp_path), "object", schema=schema).collect()
    assert sorted((r["_key"], r.x) for r in rows if r["_key"]) == [("k1", 1), ("k2", 2)]
    assert sorted(r["_corrupt_record"] for r in rows if not r["_key"]) == ["[1]", '{"k3":{"x":3},"k4":{"x"']
    with pytest.raises(PySparkException, match="malformed JSON document.*json"):
        read_json(spark, str(tmp_path), "object", schema="x int", strict=True).collect()
    assert read_json(spark, str(tmp_path / "good.json"), "object", schema="x int", strict=True).columns == ["_key", "x"]


def test_json_layouts(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "a.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "o.json").write_text('{"k1":{"a":1},"k2":{"a":2,"b":"x","c":{"d":[1,2]}}}')
    assert [r.a for r in read_json(spark, str(tmp_path / "l.json")).collect()] == [1, 2]
    assert [r.a for r in read_json(spark, str(tmp_path / "a.json"), "array").collect()] == [1, 2]
    rows = {r["_key"]: r for r in read_json(spark, str(tmp_path / "o.json"), "object").collect()}
    assert rows["k1"].a == 1 and rows["k1"].b is None and rows["k2"].b == "x" and rows["k2"].c.d == [1, 2]


DOCUMENTS = [
    '[{"a":1},{"a":2,"b":{"c":"}]{\\"\\\\"}}\n , {"a":3}]', '\ufeff [{"a":[{"x":1},{"y":[2]}]},{"a":[]}] \n', '[{"a":1},{"a":oops},{"a":"\\\\}"},5]', "[]",
    '{"a":{"x":1},"a":{"x":2}, "b":{"x":"\\"}"}}', '{"a":{"x":1}} tail', '{"a":{}}\n', '[{"a":1},{"a":2', '{"a":{"x":"}', '[1]]', '{"a":1}{"b":2}',
]


def json_records(text: str, openers: str, bounds: list[int]) -> list[tuple[bool, bytes]]:
    """What the blocks between ``bounds`` give; a piece belongs to the block that holds the byte before it."""
    raw = text.encode()
    pieces, at = [], 0
    for piece in raw.removesuffix(b"}").split(b"}") if raw.endswith(b"}") else raw.split(b"}"):
        pieces.append((at, piece))
        at += len(piece) + 1
    dealt: dict[int, list[bytes]] = {}
    for place, piece in pieces:
        dealt.setdefault(max(b for b in bounds if b < place or b == 0), []).append(piece)
    rows = []
    for bound, found in dealt.items():
        block = documents._Block()
        for piece in found:
            block.add(piece)
        rows.append({"file": "f", "length": len(raw), "block": bound, "key": bound} | dict(zip(documents._SUMMARY, block.row(), strict=True)))
    starts = documents._starts(rows, openers)
    out: list[tuple[bool, bytes]] = []
    for bound, found in dealt.items():
        block = documents._Records(*starts[bound])
        for _, _, _, kind, piece in [row for p in found for row in block.add(p)] + list(block.close()):
            if kind in (documents.MIDDLE, documents.HEAD) or (kind == documents.BROKEN and out):
                out[-1] = (kind == documents.BROKEN, out[-1][1] + piece)
            else:
                out.append((kind == documents.BROKEN, piece))
    return out


def test_json_blocks_may_end_at_any_byte():
    """One or two boundaries at every byte of small documents; escapes, strings, depth and broken documents cross them."""
    found = {}
    for text in DOCUMENTS:
        for openers in ("{[", " {"):
            expected = found[text, openers] = json_records(text, openers, [0])
            n = len(text.encode())
            for first in range(1, n + 1):
                for second in range(first, n + 1):
                    assert json_records(text, openers, [0, first, second]) == expected, (text, first, second)
    plain = lambda text, openers="{[": [(b, r.strip(b" \n,").decode()) for b, r in found[text, openers]]
    assert plain(DOCUMENTS[0]) == [(False, x) for x in ('{"a":1}', '{"a":2,"b":{"c":"}]{\\"\\\\"}}', '{"a":3}')]
    assert plain(DOCUMENTS[1]) == [(False, '{"a":[{"x":1},{"y":[2]}]}'), (False, '{"a":[]}')]
    assert plain(DOCUMENTS[2]) == [(False, '{"a":1}'), (False, '{"a":oops}'), (False, '{"a":"\\\\}"}'), (False, "5")]
    assert plain(DOCUMENTS[3]) == []
    assert plain(DOCUMENTS[4]) == [(False, DOCUMENTS[4])]
    assert plain(DOCUMENTS[4], " {") == [(False, '"a":{"x":1}'), (False, '"a":{"x":2}'), (False, '"b":{"x":"\\"}"}')]
    assert plain(DOCUMENTS[5], " {") == [(False, '"a":{"x":1}'), (False, "tail")]
    assert plain(DOCUMENTS[6], " {") == [(False, '"a":{}')]
    for text in DOCUMENTS[7:]:
        assert found[text, " {"] == [(True, text.encode())]


def test_json_documents_in_many_blocks(spark, tmp_path, block_size):
    """Large documents are read by more tasks than files; repeated keys and fields count last, a broken record is one row."""
    records = [f'{{"id": {i}, "text": "}} \\" {{ {i}", "deep": [{{"x": {i}}}]}}' for i in range(4000)]
    records[1234] = '{"id": oops}'
    (tmp_path / "a.json").write_text("[" + ",\n".join(records) + "]")
    entries = [f'"k{i}": {r}' for i, r in enumerate(records)] + ['"k7": {"id": 1, "id": -7}', '"k8": {"id": -8}']
    (tmp_path / "o.json").write_text("{" + ", ".join(entries) + "}")
    block_size(60_000)
    for name, layout in (("a.json", "array"), ("o.json", "object")):
        assert blocks.scan(spark, str(tmp_path / name), "}").rdd.getNumPartitions() > 3
        rows = read_json(spark, str(tmp_path / name), layout).select("id", "text", "deep", "_corrupt_record").collect()
        assert [r._corrupt_record.strip()[-12:] for r in rows if r._corrupt_record] == ['{"id": oops}']
        good = {r.id: r for r in rows if not r._corrupt_record}
        assert len(good) == len(rows) - 1 == 3999
        assert all(r.text == f'}} " {{ {i}' and r.deep[0].x == i for i, r in good.items() if i > 0)
        assert (7 in good, -7 in good, -8 in good) == ((True, False, False) if layout == "array" else (False, True, True))


def test_json_object_above_the_size_of_a_variant(spark, tmp_path):
    """A document of 140 MB; nothing but its records is ever one value."""
    pad = "x" * 14_000
    with open(tmp_path / "o.json", "w") as out:
        out.write("{" + ",".join(f'"k{i}":{{"id":{i},"pad":"{pad}"}}' for i in range(10_000)) + "}")
    rows = read_json(spark, str(tmp_path / "o.json"), "object", schema="id int, pad string")
    assert rows.agg(F.sum("id"), F.min(F.length("pad")), F.countDistinct("_key")).first() == (49_995_000, 14_000, 10_000)


def test_json_in_an_encoding_that_cannot_be_cut(spark, tmp_path):
    (tmp_path / "o.json").write_bytes('{"k": {"name": "é}"}, "l": {"name": "漢"}}'.encode("utf-16"))
    assert sorted(r.name for r in read_json(spark, str(tmp_path / "o.json"), "object", encoding="UTF-16").collect()) == ["é}", "漢"]


def test_json_columns_and_caps(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1,"b":2},{"a":2,"b":3}]')
    path = str(tmp_path / "a.json")
    assert read_json(spark, path, "array", columns=["b", "nope", "a"]).columns == ["b", "a"]
    assert read_json(spark, path, "array", nrows=1).count() == 1
    assert read_json(spark, path, "array", nrows=0).count() == 2


def test_json_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"code":"007"}\n')
    assert read_json(spark, str(tmp_path / "l.json")).first().code == "007"


def test_json_unknown_layout(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported layout"):
        read_json(spark, str(tmp_path), "columns")


def test_json_object_of_scalars_is_refused(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"k1": 5, "k2": 6}')
    with pytest.raises(ValueError, match="must be objects"):
        read_json(spark, str(tmp_path / "o.json"), "object")


def test_inventory(spark, sample_csv, tmp_path):
    row = file_inventory(spark, sample_csv, "utf-8", ",").first()
    assert row.file_name == "sample.csv" and row.size_bytes == len(SAMPLE) and row.encoding == "utf-8" and row.delimiter == ","
    assert row.file_path.endswith("sample.csv") and row.error is None
    missing = file_inventory(spark, str(tmp_path / "nope")).first()
    assert missing.error == "File not found" and missing.size_bytes is None
    assert oversized_files(file_inventory(spark, sample_csv), 500).count() == 0


def test_guards(spark):
    assert record_guard(spark.range(11), 10).first().exceeded
    assert not record_guard(spark.range(10), 10).first().exceeded
    with pytest.raises(ValueError):
        guarded(spark.range(11), 10)


def test_jdbc_options():
    assert source_options("jdbc:x", table="test_table")["dbtable"] == "test_table"
    both = source_options("jdbc:x", query="SELECT id FROM t;", table="ignored")
    assert both["dbtable"] == "(SELECT id FROM t) source_query"
    split = source_options("jdbc:x", table="t", ranges=KeyRange("id", 0, 99, 4), connection={"user": "u"})
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "4" and split["user"] == "u"


def test_jdbc_needs_query_or_table(spark):
    with pytest.raises(ValueError, match="Must provide either"):
        read_jdbc(spark, "jdbc:x")


def test_jdbc_page_ranges():
    assert page_ranges("id", 1, 25_000).partitions == 3
    assert page_ranges("id", 5, 5).partitions == 1
    assert page_ranges("id", 0, 10**12 - 1).partitions == 10**8


def test_jdbc_bounds_are_left_to_the_database():
    assert bounds_query("SELECT * FROM t;", "id") == "SELECT MIN(id) AS low, MAX(id) AS high FROM (SELECT * FROM t) keyed"


def test_catalog_listing(spark):
    catalog = spark.createDataFrame(
        [("public", "b"), ("public", "a"), ("other", "c")], "table_schema string, table_name string"
    )
    assert [r.table_name for r in tables_of(catalog, ["public"]).collect()] == ["a", "b"]


def test_parameters(spark):
    spark.createDataFrame([("x", True), ("y", False)], "name string, is_active boolean").createOrReplaceTempView("pl")
    assert [r.name for r in bound_query(spark, "SELECT name FROM pl WHERE is_active = :active", {"active": True}).collect()] == ["x"]
    assert with_parameters(spark.table("pl"), name="y").count() == 1


def test_session_listing(spark):
    spark.range(1).createOrReplaceTempView("zz_listed")
    spark.range(1).createOrReplaceTempView("aa_listed")
    names = [r.table_name for r in list_views(spark).collect()]
    assert names == sorted(names) and {"zz_listed", "aa_listed"} <= set(names)


def test_json_object_in_another_encoding(spark, tmp_path):
    (tmp_path / "o.json").write_bytes('{"k": {"name": "Muñoz"}}'.encode("latin-1"))
    assert read_json(spark, str(tmp_path / "o.json"), "object", encoding="ISO-8859-1").first().name == "Muñoz"


def test_json_malformed_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a":1}\n{"a":\n')
    assert read_json(spark, str(tmp_path / "l.json")).where("a IS NULL").count() == 1
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_json(spark, str(tmp_path / "l.json"), schema="a int", strict=True).collect()


def test_numbers_that_only_look_like_numbers(spark, tmp_path):
    cells = ["1_000", "1d", "2f", "0x1F", "5L", "--1", "1e", "+", "."]
    for i, cell in enumerate(cells):
        (tmp_path / f"{i}.csv").write_text(f"a\n{cell}\n")
        assert types(read_csv(spark, str(tmp_path / f"{i}.csv"))) == {"a": "string"}, cell
    for i, (cell, kind) in enumerate([(" 7 ", "bigint"), ("+7", "bigint"), ("7.", "double"), (".5e-3", "double"), ("-Infinity", "double")]):
        (tmp_path / f"n{i}.csv").write_text(f"a\n{cell}\n")
        assert types(read_csv(spark, str(tmp_path / f"n{i}.csv"))) == {"a": kind}, cell


@pytest.fixture
def many_documents(spark, tmp_path):
    """Documents with line breaks and quotes; the first and the last one come twice, one has no text."""
    rows = [(i, None if i == 7 else f'text "{i}"\n}}, {{' + "x" * (i % 50), "en", f"s{i}", i % 3) for i in [0, *range(300), 299]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def written_files(monkeypatch, size: int) -> list[str]:
    """The folders that queries write from now on, in files of ``size`` bytes."""
    made = []
    monkeypatch.setattr(file_queries, "FILE_BYTES", size)
    monkeypatch.setattr(file_queries, "scratch_path", lambda *args: made.append(scratch_path(*args)) or made[-1])
    return made


def sizes(folder: str) -> list[int]:
    return [p.stat().st_size for p in Path(folder.removeprefix("file:")).glob("part-*")]


@pytest.mark.parametrize("size, files", [(1 << 20, 1), (4000, 8)])
def test_array_documents_have_a_bounded_size(spark, many_documents, monkeypatch, size, files):
    folder, rows = many_documents
    made = written_files(monkeypatch, size)
    found = file_queries.json_split_array(spark, folder).collect()
    assert files <= len(sizes(made[0])) <= 1.5 * files and max(sizes(made[0])) < 2 * size
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("size, files", [(1 << 20, 1), (4000, 6)])
def test_object_documents_have_a_bounded_size(spark, many_documents, monkeypatch, size, files):
    """Equal keys stand in one document, whatever the number of documents: the last one counts."""
    folder, rows = many_documents
    made = written_files(monkeypatch, size)
    found = file_queries.json_split_object(spark, folder).collect()
    assert files <= len(sizes(made[0])) <= 1.5 * files + 1 and max(sizes(made[0])) < 2 * size
    good = {f"k{i}": (None if i % 5 == 0 else text, n) for i, text, _, _, n in rows if i % 7}
    assert len([r for r in found if r["_key"]]) == len(good)
    assert {r["_key"]: (r["text"], r["n_chars"]) for r in found if r["_key"]} == good
    assert sorted(r["broken_chars"] for r in found if not r["_key"]) == sorted(len(str(i)) + 16 for i, *_ in rows if i % 7 == 0)


def key_joins(df) -> list[str]:
    """The joins of the plan that shuffle and sort rows by their keys."""
    return [x for x in df._jdf.queryExecution().toString().splitlines() if "SortMergeJoin" in x and "_key" in x]


def test_values_stay_where_they_are_if_keys_are_repeated(spark, tmp_path, monkeypatch):
    """Too many keys for a broadcast: marks are looked up, and no copy of the values is written or shuffled."""
    kept = []
    monkeypatch.setattr(json_files, "written", lambda df, label: kept.append(written(df, label)) or kept[-1])
    (tmp_path / "o.json").write_text("{" + ", ".join(f'"k{i % 700}": {{"id": {i}}}' for i in range(1000)) + "}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = read_json(spark, str(tmp_path), "object", schema="id int, _corrupt_record string")
        assert key_joins(df) == [] and not any("_value" in x.columns for x in kept)
        assert sorted(r.id for r in df.collect()) == list(range(300, 1000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("every", [1, 3, 50_000])
def test_last_of_repeated_keys_in_many_records(spark, tmp_path, monkeypatch, every):
    """Over 32,768 records in a block, and several blocks; records of several entries, of which only some come again."""
    chance = random.Random(every)
    for name, size in (("a", 40_000), ("b", 3000)):
        keys = [f"k{chance.randrange(size)}" for _ in range(size)]
        entries = [(k, {"id": i} if i % every == 0 or i + 1 == size else i) for i, k in enumerate(keys)]
        (tmp_path / f"{name}.json").write_text("{" + ",".join(f'"{k}":{json.dumps(v)}' for k, v in entries) + "}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600k")
    try:
        found = read_json(spark, str(tmp_path), "object", schema="id int").groupBy("_key", "id").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    last = [json.loads((tmp_path / f"{name}.json").read_text()) for name in "ab"]
    wanted = Counter((k, v["id"] if isinstance(v, dict) else None) for x in last for k, v in x.items())
    assert {(r["_key"], r.id): r["count"] for r in found} == wanted


@pytest.mark.parametrize("size, files", [(1 << 20, 2), (2000, 8)])
def test_quoted_files_have_a_bounded_size(spark, many_documents, monkeypatch, size, files):
    folder, rows = many_documents
    made = written_files(monkeypatch, size)
    found = file_queries.csv_split_quoted(spark, folder).collect()
    assert files <= len(sizes(made[0])) <= 1.5 * files and max(sizes(made[0])) < 2 * size
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr)
