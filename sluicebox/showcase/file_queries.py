"""Reading and writing CSV and JSON, chunks, pages, inventories and guards."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators import rules as R
from sluicebox.operators.ordering import page, pages, row_index
from sluicebox.operators.sinks import write_csv
from sluicebox.scratch import scratch_path
from sluicebox.showcase.registry import query, table
from sluicebox.sources.bounds import page_bounds
from sluicebox.sources.chunks import BLOCK_BITS, map_chunks, with_chunks
from sluicebox.sources.delimited import merged_options, read_csv, read_csv_quarantined
from sluicebox.sources.inventory import file_inventory, oversized_files, record_guard
from sluicebox.sources.jdbc import tables_of
from sluicebox.sources.json_files import read_json
from sluicebox.streaming.folders import check_folder
from sluicebox.streaming.keys import check_folder_keys

ROWS_PER_DOCUMENT = 5000
#: A file of several blocks, which one task writes.
FILE_BYTES = 256 << 20


def _files(size: DataFrame, least: int) -> int:
    """How many files of FILE_BYTES hold the bytes that ``size`` gives, ``least`` at the least."""
    return max(least, math.ceil((size.first()[0] or 0) / FILE_BYTES))


@query("csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(table(spark, folder, "documents"), path)
    return read_csv(spark, path)


@query("csv_split_quoted", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_split_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose texts hold line breaks, two or as many as FILE_BYTES asks for, read in blocks."""
    path = scratch_path(spark, "csv")
    documents = table(spark, folder, "documents")
    row = sum(F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 1 for c in documents.columns)
    write_csv(documents.repartition(_files(documents.agg(F.sum(row)), 2)), path)
    return read_csv(spark, path, split=True)


@query(
    "csv_infer",
    """SELECT p_partkey, p_name, CASE WHEN p_size <> 7 THEN CAST(p_size AS BIGINT) END AS size,
              p_size > 25 AS large, CASE WHEN p_size <> 7 THEN p_retailprice END AS price,
              CASE WHEN p_size = 7 THEN 'x1' ELSE CAST(p_size AS VARCHAR) END AS mixed,
              '1994-05-06' AS day, CAST(NULL AS DOUBLE) AS nothing
       FROM part""",
)
def csv_infer(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    known = F.col("p_size") != 7
    written = table(spark, folder, "part").select(
        "p_partkey",
        "p_name",
        F.when(known, F.col("p_size").cast("string")).otherwise("N/A").alias("size"),
        F.when(F.col("p_size") > 25, "True").otherwise("False").alias("large"),
        F.when(known, F.col("p_retailprice").cast("string")).otherwise("NaN").alias("price"),
        F.when(known, F.col("p_size").cast("string")).otherwise("x1").alias("mixed"),
        F.lit("1994-05-06").alias("day"),
        F.lit("null").alias("nothing"),
    )
    write_csv(written, path)
    return read_csv(spark, path)


@query(
    "csv_dialect",
    """SELECT c_custkey, c_name || ' é; "ñ"' AS label, c_acctbal FROM customer""",
)
def csv_dialect(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    label = F.concat("c_name", F.lit(' é; "ñ"')).alias("label")
    customers = table(spark, folder, "customer").select("c_custkey", label, "c_acctbal")
    write_csv(customers, path, delimiter=";", encoding="ISO-8859-1")
    return read_csv(spark, path, encoding="ISO-8859-1", delimiter=";")


@query("csv_usecols", "SELECT o_orderkey, o_orderdate FROM orders")
def csv_usecols(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(table(spark, folder, "orders"), path)
    config = {"usecols": ["o_orderdate", "o_orderkey"], "infer": True, "multi_line": False}
    options = merged_options(config, parse_dates=["o_orderdate"], dtype={"o_orderkey": "bigint"})
    return read_csv(spark, path, options)


@query(
    "csv_headerless",
    """SELECT s_suppkey AS key, s_name AS name, nullif(s_nationkey, 7)::BIGINT AS nation, s_acctbal AS balance
       FROM supplier""",
)
def csv_headerless(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table(spark, folder, "supplier").write.csv(path)
    df = read_csv(spark, path, header=False, names=("key", "name", "nation", "balance"), infer=False,
                  dtype={"key": "bigint", "balance": "double"}, na_values=("missing",))
    nation = F.col("nation").cast("bigint")
    return df.select("key", "name", F.when(nation != 7, nation).alias("nation"), "balance")


def _ragged(spark: SparkSession, folder: str) -> str:
    """Orders as raw lines: pending ones have a field too many, finished ones a field too few."""
    path = scratch_path(spark, "ragged")
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority")
    extra = F.concat(line, F.lit(',"a, ""b"""'))
    short = F.concat_ws(",", "o_orderkey", "o_orderstatus")
    status = F.col("o_orderstatus")
    lines = table(spark, folder, "orders").select(
        F.when(status == "P", extra).when(status == "F", short).otherwise(line).alias("value")
    )
    lines.write.text(path)
    return path


RAGGED_NAMES = ("key", "status", "priority")


@query(
    "csv_quarantine_good",
    """SELECT o_orderkey AS key, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def csv_quarantine_good(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = read_csv_quarantined(spark, _ragged(spark, folder), header=False, names=RAGGED_NAMES)
    return good


@query(
    "csv_quarantine_bad",
    '''SELECT o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority || ',"a, ""b"""' AS raw
       FROM orders WHERE o_orderstatus = 'P' ''',
)
def csv_quarantine_bad(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = read_csv_quarantined(spark, _ragged(spark, folder), header=False, names=RAGGED_NAMES, infer=False)
    return bad


def _piece(key: str) -> Column:
    return F.floor(F.col(key) / ROWS_PER_DOCUMENT).cast("bigint")


def _csv_pieces(spark: SparkSession, folder: str) -> str:
    """Orders as one CSV file per ROWS_PER_DOCUMENT keys, sorted by key."""
    path = scratch_path(spark, "pieces")
    orders = table(spark, folder, "orders").withColumn("piece", _piece("o_orderkey"))
    (
        orders.repartition("piece")
        .sortWithinPartitions("piece", "o_orderkey")
        .write.partitionBy("piece")
        .option("header", True)
        .csv(path)
    )
    return path


STREAM_FILES = 300


def _csv_stream(spark: SparkSession, folder: str) -> str:
    """Orders as CSV files of ROWS_PER_DOCUMENT rows, of more where these would be over STREAM_FILES files.

    So the pieces of a stream are many, and larger in a larger table, but their number has a bound, as has what a piece costs besides its rows.
    """
    path = scratch_path(spark, "stream")
    orders = table(spark, folder, "orders")
    files = min(STREAM_FILES, max(1, math.ceil(orders.count() / ROWS_PER_DOCUMENT)))
    orders.repartition(files).write.option("header", True).csv(path)
    return path


CHUNK_ROWS = 300
NUMBERED_ORDERS = f"""
    SELECT o_orderkey // {ROWS_PER_DOCUMENT} AS piece, o_orderkey, o_orderstatus,
           row_number() OVER (PARTITION BY o_orderkey // {ROWS_PER_DOCUMENT} ORDER BY o_orderkey) - 1 AS r FROM orders"""


@query(
    "csv_chunks",
    f"""WITH n AS ({NUMBERED_ORDERS})
    SELECT piece, r // {CHUNK_ROWS} AS chunk_id, count(*) AS records, min(o_orderkey) AS first_key,
           max(o_orderkey) AS last_key FROM n GROUP BY ALL""",
)
def csv_chunks(spark: SparkSession, folder: str) -> DataFrame:
    scan = read_csv(spark, _csv_pieces(spark, folder), multi_line=False, parse_dates=("o_orderdate",))
    chunked = with_chunks(scan, CHUNK_ROWS)
    return chunked.groupBy(_piece("o_orderkey").alias("piece"), "chunk_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query(
    "csv_chunk_map",
    f"""WITH n AS ({NUMBERED_ORDERS})
    SELECT r // {CHUNK_ROWS} AS chunk_id, min(o_orderkey) AS first_key, count(*) AS records,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM n GROUP BY piece, chunk_id""",
)
def csv_chunk_map(spark: SparkSession, folder: str) -> DataFrame:
    def summary(piece: pd.DataFrame) -> pd.DataFrame:
        pending = int((piece["o_orderstatus"] == "P").sum())
        first = piece.iloc[0]
        return pd.DataFrame([(first["chunk_id"], first["o_orderkey"], len(piece), pending)])

    scan = read_csv(spark, _csv_pieces(spark, folder), multi_line=False, usecols=("o_orderkey", "o_orderstatus"))
    schema = "chunk_id bigint, first_key bigint, records bigint, pending bigint"
    return map_chunks(with_chunks(scan, CHUNK_ROWS), summary, schema)


@query(
    "csv_skiprows",
    """SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def csv_skiprows(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    suppliers = table(spark, folder, "supplier")
    header = F.lit("exported for a test\nsecond, line, of the preamble, longer\ns_suppkey,s_name,s_acctbal\n")
    line = F.concat_ws(",", "s_suppkey", "s_name", "s_acctbal")
    body = suppliers.groupBy(_piece("s_suppkey").alias("piece")).agg(F.concat(header, F.array_join(F.collect_list(line), "\n")).alias("value"))
    body.write.partitionBy("piece").text(path)
    return read_csv(spark, path, skiprows=2, multi_line=False)


@query(
    "csv_stream_checks",
    """SELECT 'o_orderstatus_accepted' AS rule_name, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS failed_count,
              count(*) AS records FROM orders
       UNION ALL SELECT 'o_totalprice_range', count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 400000), count(*)
       FROM orders""",
)
def csv_stream_checks(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "orders").schema
    rules = [R.accepted_values("o_orderstatus", ["O", "F"]), R.in_range("o_totalprice", 1000, 400000)]
    pieces = check_folder(
        spark, _csv_stream(spark, folder), schema, rules, scratch_path(spark, "checked"), scratch_path(spark, "progress"),
        files_per_piece=10, options={"header": True, "recursiveFileLookup": True},
    )
    return pieces.groupBy("rule_name").agg(
        F.sum("failed_count").alias("failed_count"), F.sum("records_processed").alias("records")
    )


@query(
    "csv_stream_unique",
    """SELECT 'o_custkey_unique' AS rule_name, 'unique' AS rule_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS failed_count
       FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)
       UNION ALL SELECT 'o_orderkey_unique', 'unique', CAST(coalesce(sum(n), 0) AS BIGINT)
       FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
       UNION ALL SELECT 'o_custkey_references', 'references', count(*) FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def csv_stream_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all pieces together: the orders of a customer stand in many of them."""
    schema = table(spark, folder, "orders").schema
    known = table(spark, folder, "customer").where(F.col("c_mktsegment") != "BUILDING")
    rules = [R.unique("o_custkey"), R.unique("o_orderkey"), R.references("o_custkey", known, "c_custkey")]
    return check_folder_keys(
        spark, _csv_stream(spark, folder), schema, rules, scratch_path(spark, "checked"), scratch_path(spark, "progress"),
        files_per_piece=10, options={"header": True, "recursiveFileLookup": True},
    )


@query(
    "json_lines",
    """SELECT o_totalprice, o_orderkey, o_orderstatus AS status, [o_orderpriority, o_orderstatus] AS words FROM orders""",
)
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    nested = F.struct(F.col("o_orderstatus").alias("status"), F.array("o_orderpriority", "o_orderstatus").alias("words"))
    table(spark, folder, "orders").withColumn("nested", nested).write.json(path)
    found = read_json(spark, path, columns=["o_totalprice", "no_such_column", "o_orderkey", "nested"])
    return found.select("o_totalprice", "o_orderkey", "nested.status", "nested.words")


def _write_documents(df: DataFrame, key: str, document: Column, path: str) -> None:
    """One file per ROWS_PER_DOCUMENT keys with the JSON document of these rows; ``key`` is unique."""
    pieces = df.groupBy(_piece(key).alias("piece")).agg(document.alias("value"))
    pieces.write.partitionBy("piece").text(path)


@query("json_array", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_array(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    customers = table(spark, folder, "customer")
    _write_documents(customers, "c_custkey", F.to_json(F.collect_list(F.struct(*customers.columns))), path)
    return read_json(spark, path, layout="array")


@query(
    "json_object",
    """SELECT 'order-' || o_orderkey AS _key, o_orderkey AS id, o_orderstatus AS status,
              CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""",
)
def json_object(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    value = F.struct(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
    )
    entry = F.struct(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), value)
    orders = table(spark, folder, "orders")
    _write_documents(orders, "o_orderkey", F.to_json(F.map_from_entries(F.collect_list(entry))), path)
    found = read_json(spark, path, layout="object", columns=["_key", "id", "status", "price"])
    return found.withColumn("price", F.col("price").cast("double"))


@query(
    "json_object_broken",
    f"""WITH p AS (SELECT o_orderkey // {ROWS_PER_DOCUMENT} AS piece, o_orderkey, o_orderstatus FROM orders)
        SELECT 'order-' || o_orderkey AS _key, o_orderstatus AS status, NULL::BIGINT AS broken_chars, NULL::VARCHAR AS broken_start
        FROM p WHERE piece % 2 = 0
        UNION ALL SELECT NULL, NULL, sum(length(o_orderkey::VARCHAR) + 24)::BIGINT, '{{"order-' FROM p WHERE piece % 2 = 1 GROUP BY piece""",
)
def json_object_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Every second document is cut off by its last character."""
    path = scratch_path(spark, "json")
    orders = table(spark, folder, "orders")
    entry = F.struct(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), F.struct(F.col("o_orderstatus").alias("status")))
    whole = F.to_json(F.map_from_entries(F.collect_list(entry)))
    cut = F.when(F.first(_piece("o_orderkey")) % 2 == 0, whole).otherwise(F.regexp_replace(whole, r"\}$", ""))
    _write_documents(orders, "o_orderkey", cut, path)
    found = read_json(spark, path, layout="object", schema="status string, _corrupt_record string")
    broken = F.regexp_replace(F.col("_corrupt_record"), r"\s+$", "")
    return found.select(
        "_key", "status", F.length(broken).cast("bigint").alias("broken_chars"), F.substring(broken, 1, 8).alias("broken_start")
    )


def _documents(spark: SparkSession, records: DataFrame, order: str, opening: str, closing: str) -> str:
    """Files of about FILE_BYTES with ``value`` of the records between the brackets, each one document in the order of ``order``.

    A file has one writer, so more records make more files. Records of equal ``order`` stand in one document. Keys are dealt by
    a hash: files differ little in size, whatever the sizes of neighbours. Records without a value are left out.
    """
    path = scratch_path(spark, "json")
    known = records.where("value IS NOT NULL")
    files = _files(known.agg(F.sum(F.octet_length("value") + 2)), 1)
    dealt = known.select(F.pmod(F.xxhash64(order), F.lit(files)).cast("int").alias("file"), F.lit(False).alias("end"), order, "value")
    nothing = F.lit(None).cast(records.schema[order].dataType).alias(order)
    ends = spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(True).alias("end"), nothing, F.lit(closing).alias("value"))
    sorted_files = dealt.unionByName(ends).repartitionById(files, F.col("file")).sortWithinPartitions("end", order)
    # The rows of a task are numbered from 0 in their order.
    first = F.monotonically_increasing_id().bitwiseAND((1 << BLOCK_BITS) - 1) == 0
    before = F.when(first, opening).when(F.col("end"), "").otherwise(",")
    sorted_files.select(F.concat(before, "value").alias("value")).write.text(path)
    return path


@query("json_split_array", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_split_array(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as arrays, each of many in one file, read in blocks."""
    documents = table(spark, folder, "documents")
    records = documents.select("doc_id", F.to_json(F.struct(*documents.columns)).alias("value"))
    found = read_json(spark, _documents(spark, records, "doc_id", "[", "]"), layout="array")
    return found.select(*documents.columns)


@query(
    "json_split_object",
    """SELECT 'k' || doc_id AS _key, CASE WHEN doc_id % 5 <> 0 THEN text END AS text, n_chars, NULL::INT AS broken_chars FROM documents WHERE doc_id % 7 <> 0
       UNION ALL SELECT NULL, NULL, NULL, (length(doc_id::VARCHAR) + 16)::INT FROM documents WHERE doc_id % 7 = 0""",
)
def json_split_object(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as objects, each of many in one file: every seventh value is broken, every fifth key comes again without its text."""
    documents = table(spark, folder, "documents")
    key = F.concat(F.lit('"k'), F.col("doc_id"), F.lit('": '))
    value = F.concat(key, F.to_json(F.struct("text", "n_chars")))
    again = F.when(F.col("doc_id") % 5 == 0, F.concat(value, F.lit(", "), key, F.to_json(F.struct("n_chars")))).otherwise(value)
    entry = F.when(F.col("doc_id") % 7 == 0, F.concat(key, F.lit('{"n": oops}'))).otherwise(again)
    path = _documents(spark, documents.select("doc_id", entry.alias("value")), "doc_id", "{", "}")
    found = read_json(spark, path, layout="object", schema="text string, n_chars bigint, _corrupt_record string")
    broken = F.length(F.regexp_replace("_corrupt_record", r"^\s+|\s+$", ""))
    return found.select("_key", "text", "n_chars", broken.alias("broken_chars"))


@query(
    "csv_nrows",
    """SELECT * FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 7)""",
)
def csv_nrows(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy("s_suppkey")
    write_csv(suppliers, path)
    return read_csv(spark, path, nrows=7)


@query(
    "json_nrows",
    """SELECT 'lines' AS layout, least(count(*), 5) AS records, 0::BIGINT AS records_of_none FROM customer
       UNION ALL SELECT 'array', least(count(*), 5), count(*) FROM customer
       UNION ALL SELECT 'object', least(count(*), 5), count(*) FROM customer""",
)
def json_nrows(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    paths = {layout: scratch_path(spark, "json") for layout in ("lines", "array", "object")}
    customers.write.json(paths["lines"])
    _write_documents(customers, "c_custkey", F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))), paths["array"])
    entry = F.struct(F.col("c_custkey").cast("string"), F.struct("c_name"))
    _write_documents(customers, "c_custkey", F.to_json(F.map_from_entries(F.collect_list(entry))), paths["object"])

    def rows(layout: str, nrows: int, name: str) -> DataFrame:
        return read_json(spark, paths[layout], layout=layout, nrows=nrows).agg(F.count(F.lit(1)).alias(name))

    counts = [
        rows(n, 5, "records").crossJoin(rows(n, 0, "records_of_none")).select(F.lit(n).alias("layout"), "records", "records_of_none")
        for n in paths
    ]  # single rows
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "catalog_tables",
    """SELECT DISTINCT lower(p_brand) AS table_name FROM part WHERE p_size IN (1, 2, 3)""",
)
def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue of tables in schemas, as a database keeps it, listed by schema."""
    catalog = table(spark, folder, "part").select(
        F.concat(F.lit("s"), F.col("p_size")).alias("table_schema"), F.lower("p_brand").alias("table_name")
    ).distinct()
    return tables_of(catalog, ["s1", "s2", "s3"]).distinct()


@query(
    "file_inventory",
    """SELECT c_nationkey::VARCHAR AS nation, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS size_bytes,
              round_even(sum(octet_length(encode(c_name)) + 1) / 1048576.0, 2)::DOUBLE AS size_mb,
              sum(octet_length(encode(c_name)) + 1) > 512 AS over, NULL::VARCHAR AS error
       FROM customer GROUP BY c_nationkey
       UNION ALL SELECT NULL, NULL, NULL, NULL, 'File not found'""",
)
def inventory_of_folders(spark: SparkSession, folder: str) -> DataFrame:
    """One file per nation, and a path that does not exist."""
    path = scratch_path(spark, "names")
    names = table(spark, folder, "customer").select("c_nationkey", "c_name")
    names.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    found = file_inventory(spark, path, layout="text").where(F.col("file_name").endswith(".txt"))
    missing = file_inventory(spark, scratch_path(spark, "no such folder"))
    large = oversized_files(found, max_mb=512 / 1024**2).select("file_path", F.lit(True).alias("over"))
    both = found.join(large, "file_path", "left").unionByName(missing, allowMissingColumns=True)
    nation = F.nullif(F.regexp_extract("file_path", "c_nationkey=([0-9]+)", 1), F.lit(""))
    over = F.when(nation.isNotNull(), F.coalesce("over", F.lit(False)))
    return both.select(nation.alias("nation"), "size_bytes", F.col("size_mb").cast("double").alias("size_mb"), over.alias("over"), "error")


@query("table_pages", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page_id FROM orders")
def table_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


@query(
    "pages_of_ties",
    """WITH n AS (SELECT l_returnflag, (row_number() OVER (ORDER BY l_returnflag) - 1) // 1000 AS page_id FROM lineitem)
       SELECT page_id, l_returnflag, count(*) AS records FROM n GROUP BY ALL""",
)
def pages_of_ties(spark: SparkSession, folder: str) -> DataFrame:
    numbered = pages(table(spark, folder, "lineitem").select("l_returnflag"), ["l_returnflag"], 1000)
    return numbered.groupBy("page_id", "l_returnflag").agg(F.count(F.lit(1)).alias("records"))


def _bounds_sql(key: str, source: str, size: int) -> str:
    """Pages start at keys whose rows begin at a multiple of the size, or after keys whose rows span one."""
    return f"""WITH k AS (SELECT {key} AS k, count(*) AS n FROM {source} WHERE {key} IS NOT NULL GROUP BY ALL),
       b AS (SELECT k, n, sum(n) OVER (ORDER BY k) - n AS b, sum(n) OVER () AS total FROM k),
       o AS (SELECT k AS low, b AS first_row, total FROM b WHERE b % {size} = 0
             UNION ALL SELECT k + 1, b + n, total FROM b WHERE b // {size} * {size} + {size} < b + n),
       p AS (SELECT max(low) AS low, first_row, total FROM o WHERE first_row < total GROUP BY ALL)
       SELECT row_number() OVER (ORDER BY low) - 1 AS page_id, CAST(low AS BIGINT) AS low, CAST(lead(low) OVER (ORDER BY low) AS BIGINT) AS high,
              CAST(first_row AS BIGINT) AS first_row, CAST(coalesce(lead(first_row) OVER (ORDER BY low), total) - first_row AS BIGINT) AS n_rows FROM p"""


@query("page_bounds", _bounds_sql("l_orderkey * 8 + l_linenumber", "lineitem", 1000))
def bounds_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of 1,000 rows on a sparse key, found by counting ranges of keys."""
    return page_bounds(table(spark, folder, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber"), 1000)


@query("page_bounds_skewed", _bounds_sql("user_id", "events", 50))
def bounds_of_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of 50 rows where keys repeat: rows of one key stay together."""
    return page_bounds(table(spark, folder, "events"), "user_id", 50)


@query("row_numbers", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events")
def row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("ts", "event_id")
    return row_index(events, ["ts", "event_id"]).select("event_id", "row_index")


@query("one_page", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 300")
def one_page(spark: SparkSession, folder: str) -> DataFrame:
    return page(table(spark, folder, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 100, 3)


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return page(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 25, 0)


@query(
    "extraction_guard",
    """SELECT CAST(1000000 AS BIGINT) AS max_records, count(*) > 1000000 AS exceeded FROM lineitem
       UNION ALL SELECT CAST(1000 AS BIGINT), count(*) > 1000 FROM lineitem""",
)
def extraction_guard(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return record_guard(lines, 1_000_000).unionByName(record_guard(lines, 1000))
