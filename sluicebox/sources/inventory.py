"""What is in a folder of files, and guards on the size of an extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

BYTES_PER_MB = 1024 * 1024

INVENTORY_SCHEMA = (
    "file_path string, file_name string, size_bytes bigint, size_mb decimal(20,2), modified_time timestamp, "
    "encoding string, delimiter string, layout string, error string"
)


def file_inventory(
    spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8", delimiter: str | None = None,
    layout: str | None = None,
) -> DataFrame:
    """One row per file below ``path``; the content is not read. A missing path gives one row with an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        files = reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        shown = path if isinstance(path, str) else ",".join(path)
        return spark.createDataFrame([(shown, None, None, None, None, None, None, None, "File not found")], INVENTORY_SCHEMA)
    return files.select(
        F.col("path").alias("file_path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("size_bytes"),
        F.bround(F.col("length").cast("decimal(20,0)") / BYTES_PER_MB, 2).cast("decimal(20,2)").alias("size_mb"),
        F.col("modificationTime").alias("modified_time"),
        F.lit(encoding).alias("encoding"),
        F.lit(delimiter).alias("delimiter"),
        F.lit(layout).alias("layout"),
        F.lit(None).cast("string").alias("error"),
    )


def oversized_files(inventory: DataFrame, max_mb: float) -> DataFrame:
    return inventory.where(F.col("size_bytes") > max_mb * BYTES_PER_MB)


def record_guard(df: DataFrame, max_records: int) -> DataFrame:
    """One row: whether the table has more rows than allowed."""
    seen = df.agg(F.count(F.lit(1)).alias("seen"))
    return seen.select(F.lit(max_records).cast("bigint").alias("max_records"), (F.col("seen") > max_records).alias("exceeded"))


def guarded(df: DataFrame, max_records: int) -> DataFrame:
    """``df`` itself, or an error if it has more rows than allowed."""
    if record_guard(df, max_records).first()["exceeded"]:
        raise ValueError(f"more than {max_records} records in one extraction")
    return df
