"""CSV reading with type inference, missing-value words, quarantine of malformed rows and reader options."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.scratch import written
from sluicebox.sources.blocks import ascii_based
from sluicebox.sources.chunks import placed
from sluicebox.sources.quoted import quoted_records

# Words that mean "missing" in a CSV cell. Fixed values.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")
CORRUPT = "_corrupt_record"
POSITION = "_position"


@dataclass(frozen=True)
class CsvOptions:
    """How to read a CSV file.

    ``multi_line`` allows line breaks inside quotes. Files larger than an input split are then read in blocks by all tasks
    (see ``quoted``), others by one task each; ``split`` forces one or the other. Both give the same rows. Blocks need an encoding in which
    line breaks, quotes and delimiters are single bytes, as in UTF-8. ``usecols`` keeps columns (unknown names are an error), ``nrows`` takes so many rows, by file, block and place,
    ``dtype`` sets types by column, ``na_values`` adds missing-value words, ``parse_dates`` names timestamp columns,
    ``names`` sets column names (then ``header`` says whether a header line is skipped), ``skiprows`` leaves out the
    first rows of each file, ``infer`` turns type inference off, ``check_width`` the check for rows with too many fields.
    """

    encoding: str = "utf-8"
    delimiter: str = ","
    multi_line: bool = True
    split: bool | None = None
    header: bool = True
    names: tuple[str, ...] | None = None
    usecols: tuple[str, ...] | None = None
    nrows: int | None = None
    dtype: Mapping[str, str] = field(default_factory=dict)
    na_values: tuple[str, ...] = ()
    keep_default_na: bool = True
    parse_dates: tuple[str, ...] = ()
    skiprows: int = 0
    infer: bool = True
    check_width: bool = True


def merged_options(config: Mapping[str, object], **call: object) -> CsvOptions:
    """Options of a source overridden by the options of one call."""
    tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in {**config, **call}.items()}
    return replace(CsvOptions(), **tuples)


def _reader(spark: SparkSession, o: CsvOptions):
    return (
        spark.read.option("header", o.header)
        .option("encoding", o.encoding)
        .option("sep", o.delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", o.multi_line)
        .option("mode", "PERMISSIVE")
        # Both stay out of the way: missing-value words are handled column by column below.
        .option("nullValue", "")
        .option("enforceSchema", True)
        .option("recursiveFileLookup", True)
    )


def _names(spark: SparkSession, path: str | Sequence[str], o: CsvOptions) -> list[str]:
    if o.names:
        return list(o.names)
    if not o.skiprows:
        return _reader(spark, o).csv(path).columns
    head = spark.read.option("recursiveFileLookup", True).option("encoding", o.encoding).text(path).limit(o.skiprows + 1)
    line = head.collect()[-1]["value"]
    return next(csv.reader([line], delimiter=o.delimiter))


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def na_words(o: CsvOptions) -> list[str]:
    return [*(NA_WORDS if o.keep_default_na else ()), *o.na_values]


def _known(c: str, words: Sequence[str]) -> Column:
    """The cell, or null where it holds a missing-value word; long cells are not compared at all."""
    col = F.col(f"`{c}`")
    if not words:
        return col
    longest = max(len(w.encode()) for w in words)
    return F.when(~((F.octet_length(col) <= longest) & col.isin(*words)), col)


# Cells are matched before they are cast: a failed cast costs an exception, a failed match does not.
LONG_TEXT = r"^\s*[+-]?\d{1,19}\s*$"
DOUBLE_TEXT = r"^\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _as_long(text: Column) -> Column:
    return F.when(text.rlike(LONG_TEXT), text.try_cast("bigint"))


def _as_double(text: Column) -> Column:
    return F.when(text.rlike(DOUBLE_TEXT), text.try_cast("double"))


def _as_boolean(text: Column) -> Column:
    return F.when(text.isin(*TRUE_WORDS), F.lit(True)).when(text.isin(*FALSE_WORDS), F.lit(False))


CASTS = {"bigint": _as_long, "double": _as_double, "boolean": _as_boolean}


def _kind(text: Column) -> Column:
    """1 for an integer, 2 for another number, 3 for a boolean, 4 for any other text."""
    return (
        F.when(text.isNull(), None)
        .when(_as_long(text).isNotNull(), 1)
        .when(text.rlike(DOUBLE_TEXT), 2)
        .when(text.isin(*TRUE_WORDS, *FALSE_WORDS), 3)
        .otherwise(4)
    )


def _type_of(lowest: int | None, highest: int | None) -> str:
    """The narrowest type for kinds between the two; a column without any value becomes double."""
    if lowest is None or highest == 2:
        return "double"
    return {(1, 1): "bigint", (3, 3): "boolean"}.get((lowest, highest), "string")


def infer_types(text: DataFrame, columns: Sequence[str], words: Sequence[str]) -> dict[str, str]:
    """bigint, double, boolean or string for each text column, in one aggregation. Dates stay text."""
    if not columns:
        return {}
    kinds = {c: _kind(_known(c, words)) for c in columns}
    seen = text.agg(*[f(k).alias(f"{f.__name__}{i}") for i, k in enumerate(kinds.values()) for f in (F.min, F.max)]).first()
    return {c: _type_of(seen[f"min{i}"], seen[f"max{i}"]) for i, c in enumerate(columns)}


def _typed(text: DataFrame, columns: Sequence[str], o: CsvOptions) -> DataFrame:
    words = na_words(o)
    declared = {**{c: "timestamp_ntz" for c in o.parse_dates}, **o.dtype}
    open_columns = [c for c in columns if c not in declared]
    inferred = infer_types(text, open_columns, words) if o.infer else dict.fromkeys(open_columns, "string")
    out = []
    for c in columns:
        known = _known(c, words)
        if c in declared:
            value = known.cast(declared[c])
        else:
            value = CASTS[inferred[c]](known) if inferred[c] in CASTS else known
        out.append(value.alias(c))
    return text.select(*out)


def _chosen(names: Sequence[str], o: CsvOptions) -> list[str]:
    if o.usecols is None:
        return list(names)
    unknown = [c for c in o.usecols if c not in names]
    if unknown:
        raise ValueError(f"columns not in the file: {unknown}")
    return [c for c in names if c in o.usecols]


def _in_blocks(spark: SparkSession, path: str | Sequence[str], o: CsvOptions) -> bool:
    """Are the files to be read in blocks? Looks at the list of files only."""
    if not o.multi_line or o.split is False:
        return False
    if not ascii_based(o.encoding):
        if o.split:
            raise ValueError(f"files in {o.encoding} cannot be cut at a byte")
        return False
    if o.split:
        return True
    limit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return not files.where(F.col("length") > limit).isEmpty()


def _parsed(spark: SparkSession, path: str | Sequence[str], o: CsvOptions, names: Sequence[str]) -> DataFrame:
    """The records of files that are read in blocks, as text with ``_position``, their place among all records."""
    found = quoted_records(spark, path, o.delimiter, o.encoding, o.skiprows + int(o.header))
    ddl = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in [*names, CORRUPT])
    options = {
        "sep": o.delimiter, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "nullValue": "",
        "columnNameOfCorruptRecord": CORRUPT,
    }
    return found.select("position", F.from_csv("record", ddl, options).alias("row")).select(
        "row.*", F.col("position").alias(POSITION)
    )


def _scan(spark: SparkSession, path: str | Sequence[str], o: CsvOptions) -> tuple[DataFrame, list[str], list[str]]:
    """The file as text with its raw malformed rows, all its column names, and the chosen ones."""
    names = _names(spark, path, o)
    columns = _chosen(names, o)
    if _in_blocks(spark, path, o):
        return _parsed(spark, path, o, names), names, columns
    reader = _reader(spark, replace(o, header=o.header and not o.skiprows))
    text = reader.schema(_text_schema([*names, CORRUPT])).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    if o.skiprows:
        text = _without_first(text, o.skiprows + int(o.header), names)
    return text, names, columns


def _without_first(text: DataFrame, rows: int, names: Sequence[str]) -> DataFrame:
    """``text`` without the first rows of each file. Only the start of a file is numbered; no row is moved.

    The skipped rows are among the first of the file's first block, which one task reads in order.
    """
    marked = placed(text)
    start = F.col("_block") == 0
    first = marked.where(start).groupBy("_file").agg(F.min("_place").alias("_first"))
    firsts = written(first, "starts").select(F.col("_file").alias("_of"), "_first")
    kept = ~start | F.col("_first").isNull() | (F.col("_place") - F.col("_first") >= rows)
    joined = marked.join(firsts, (F.col("_file") == F.col("_of")) & start, "left")
    # A skipped row may be malformed, so its raw text goes before any check of it can run.
    return joined.withColumn(CORRUPT, F.when(kept, F.col(CORRUPT))).where(kept).select(*names, CORRUPT)


def _first_rows(text: DataFrame, rows: int) -> DataFrame:
    """The first rows by file, block and place, written down: types are inferred from the very rows that are returned."""
    if POSITION in text.columns:  # fixed by the files alone
        return text.where(F.col(POSITION) < rows)
    ordered = placed(text).orderBy("_file", "_block", "_place").limit(rows)
    return written(ordered.drop("_file", "_block", "_place"), "first")


def read_csv(spark: SparkSession, path: str | Sequence[str], options: CsvOptions = CsvOptions(), **call) -> DataFrame:
    """A CSV file or folder as a typed table. Short rows are padded with nulls, long rows are an error.

    Use ``read_csv_quarantined`` to keep going past malformed rows. Without ``check_width`` long rows are cut and
    columns that are not needed are not parsed.
    """
    o = replace(options, **call)
    text, names, columns = _scan(spark, path, o)
    if o.check_width:
        complaint = F.raise_error(F.concat(F.lit("row has too many fields: "), F.col(CORRUPT))).cast("boolean")
        text = text.where(F.when(_too_long(names, o), complaint).otherwise(F.lit(True)))
    if o.nrows is not None:
        text = _first_rows(text, o.nrows)
    return _typed(text.select(*[F.col(f"`{c}`") for c in columns]), columns, o)


def _too_long(names: Sequence[str], o: CsvOptions) -> Column:
    """The raw text of a flagged row has more fields than there are columns; a row with fewer is only padded.

    Spark refuses a scan of nothing but raw text, so the condition looks at the first field as well.
    """
    outside_quotes = F.regexp_replace(F.col(CORRUPT), '"(?:[^"]|"")*"', "")
    removed = F.length(outside_quotes) - F.length(F.replace(outside_quotes, F.lit(o.delimiter), F.lit("")))
    first = F.coalesce(F.length(F.col(f"`{names[0]}`")) >= 0, F.lit(True))
    return F.col(CORRUPT).isNotNull() & (removed >= len(names) * len(o.delimiter)) & first


def read_csv_quarantined(
    spark: SparkSession, path: str | Sequence[str], options: CsvOptions = CsvOptions(), **call
) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the typed rows, and the raw text of the rows with too many fields."""
    o = replace(options, **call)
    text, names, columns = _scan(spark, path, o)
    too_long = _too_long(names, o)
    good = text.where(~too_long)
    bad = text.where(too_long).select(F.col(CORRUPT).alias("raw"))
    return _typed(good.select(*[F.col(f"`{c}`") for c in columns]), columns, o), bad


def require_clean(bad: DataFrame) -> None:
    """Raise if anything was quarantined."""
    n = bad.count()
    if n:
        raise ValueError(f"{n} malformed rows")
