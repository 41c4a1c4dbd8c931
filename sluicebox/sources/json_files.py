"""JSON reading in three layouts: one object per line, an array of objects, an object of objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.scratch import scratch_path, written
from sluicebox.sources import documents

LAYOUTS = ("lines", "array", "object")
KEY = "_key"
CORRUPT = "_corrupt_record"


def read_json(
    spark: SparkSession,
    path: str | Sequence[str],
    layout: str = "lines",
    columns: Sequence[str] | None = None,
    nrows: int | None = None,
    schema: T.StructType | str | None = None,
    encoding: str = "utf-8",
    strict: bool = False,
) -> DataFrame:
    """A JSON file or folder as a table.

    ``columns`` keeps those that exist, in the given order. ``nrows`` keeps that many rows; for the array and object
    layouts 0 means all. Documents of the array and object layouts are read in blocks by all tasks and written down as
    records first (see ``documents``), so they may be of any size. A malformed record is kept as text in ``_corrupt_record``; with
    ``strict`` it is an error. A raw line break within a record of an array is read as a space.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unsupported layout {layout!r}: use one of {', '.join(LAYOUTS)}")
    if layout == "object":
        df = _read_object(spark, path, schema, encoding, strict)
    else:
        if layout == "array":
            path, encoding = _lines_of_arrays(spark, path, encoding), "utf-8"
        reader = spark.read.option("encoding", encoding).option("recursiveFileLookup", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
        df = (reader.schema(schema) if schema is not None else reader).json(path)
    if nrows is not None and (nrows or layout == "lines"):
        df = df.limit(nrows)  # any so many rows: the types are known already
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])
    return df


def _lines_of_arrays(spark: SparkSession, path: str | Sequence[str], encoding: str) -> str:
    """A folder with the records of array documents, one a line."""
    lines = scratch_path(spark, "lines")
    found = documents.records(spark, path, "{[", encoding)
    found.select(F.regexp_replace("record", r"[\r\n]+", " ").alias("value")).write.text(lines)
    return lines


def _read_object(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None, encoding: str, strict: bool
) -> DataFrame:
    """Each top-level key is a row: ``_key`` and the columns of its value. Of equal keys of a document the last one counts.

    What is no entry, or all of a document that is no object of objects, is a row with its text in ``_corrupt_record``; the
    column is there if there is such a row, or if ``schema`` names it.
    """
    found = documents.records(spark, path, " {", encoding)
    entries = F.from_json(F.concat(F.lit("{"), F.col("record"), F.lit("}")), "map<string,string>")
    parsed = found.withColumn("_entries", F.when(~F.col("broken"), entries))
    if strict:
        complaint = F.raise_error(F.concat(F.lit("malformed JSON document: "), F.col("file")))
        parsed = parsed.withColumn("_entries", F.coalesce("_entries", complaint.cast("map<string,string>")))
    rows = _last_of_each(parsed.where("_entries IS NOT NULL"))
    if schema is None:
        rows = written(rows, "entries")  # read twice
        schema = _value_schema(rows)
    fields = T.StructType.fromDDL(schema.removeprefix("STRUCT<").removesuffix(">")) if isinstance(schema, str) else schema
    names = [f.name for f in fields.fields]
    fields = T.StructType([f for f in fields.fields if f.name != CORRUPT])
    good = rows.select(KEY, F.from_json("_value", fields).alias("_row")).select(KEY, "_row.*")
    broken = parsed.where("_entries IS NULL")
    if strict or (CORRUPT not in names and broken.isEmpty()):
        return good
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields]
    bad = broken.select(F.lit(None).cast("string").alias(KEY), *nothing, F.col("record").alias(CORRUPT))
    return good.withColumn(CORRUPT, F.lit(None).cast("string")).unionByName(bad)


def _last_of_each(records: DataFrame) -> DataFrame:
    """(key, value) of the entries of records, but those whose key comes again in their document.

    Only keys are written and shuffled, values stay where they are. A record of which an entry comes again is marked by one bit; the marks of
    a block are at most some KB, and go to all tasks. Such a record is left out, or, if it has more entries, they are
    shuffled and compared one by one.
    """
    entries = records.select(
        "file", "block", "place", (F.size("_entries") > 1).alias("several"), F.posexplode("_entries").alias("pos", KEY, "_value")
    )
    order = F.struct("block", "place", "pos")
    keys = written(entries.select("file", "several", order.alias("order"), KEY), "keys")
    places = keys.groupBy("file", KEY).agg(F.count(F.lit(1)).alias("times"), F.max("order").alias("last"))
    repeated = written(places.where("times > 1").select(F.col("file").alias("of"), F.col(KEY).alias("again"), "last"), "repeated")
    if repeated.isEmpty():
        return entries.select(KEY, "_value")
    same_key = (F.col("file") == F.col("of")) & (F.col(KEY) == F.col("again"))
    earlier = written(keys.join(repeated, same_key & (F.col("order") < F.col("last")), "left_semi").select("file", "order.*", "several"), "earlier")
    number = F.col("place") + 1  # bitmaps count from 1
    bit, bucket = F.bitmap_bit_position(number), F.bitmap_bucket_number(number)
    # Short rows are dealt, not a bitmap a block from every task.
    dealt = earlier.select("file", "block", bucket.alias("bucket"), bit.alias("bit")).repartition("file", "block", "bucket")
    bits = dealt.groupBy("file", "block", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    found = entries.withColumn("bucket", bucket).join(F.broadcast(bits), ["file", "block", "bucket"], "left")
    kept = found.where(~marked).select(KEY, "_value")
    if earlier.where("several").isEmpty():
        return kept
    rest = found.where(marked & F.col("several")).join(repeated, same_key & (order < F.col("last")), "left_anti")
    return kept.unionByName(rest.select(KEY, "_value"))


_REPEATED_FIELDS = "spark.sql.variant.allowDuplicateKeys"


def _value_schema(rows: DataFrame) -> str:
    """The common schema of all values, found by one aggregation; of a field that a value repeats the last counts."""
    spark = rows.sparkSession
    before = spark.conf.get(_REPEATED_FIELDS)
    spark.conf.set(_REPEATED_FIELDS, "true")
    try:
        found = rows.agg(F.schema_of_variant_agg(F.try_parse_json("_value"))).first()[0]
    finally:
        spark.conf.set(_REPEATED_FIELDS, before)
    if found == "VOID":  # no whole document
        return "STRUCT<>"
    if not found.startswith("OBJECT<"):
        raise ValueError(f"the values of the object layout must be objects, not {found}")
    return "STRUCT<" + found[len("OBJECT<"):].replace("OBJECT<", "STRUCT<")
