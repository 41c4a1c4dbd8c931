"""Chunked scans: fixed-size pieces of each file, in file order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.scratch import written

DEFAULT_CHUNK_SIZE = 10_000


BLOCK_BITS = 33  # rows of a scanned block, in a monotonically increasing id


def placed(scan: DataFrame) -> DataFrame:
    """A file scan with ``_file``, the file of each row, ``_block``, where its block starts there, and ``_place`` in order.

    Within a task rows are numbered in the order in which they are read, so the place orders the rows of a block.
    """
    return scan.select(
        *[F.col(f"`{c}`") for c in scan.columns],
        F.input_file_name().alias("_file"),
        F.input_file_block_start().alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )


def numbered(scan: DataFrame) -> DataFrame:
    """A file scan with ``_file``, the file of each row, and ``row_in_file``, its place there from 0.

    The scan is written down with its places, so that the numbering survives a lost executor. Then one small row a
    block says where the block's rows begin: a map from the first place of the block to the rows before it. The
    blocks that share a task's numbers are looked up by that task number, so the join moves no rows as long as the
    blocks are few enough to be broadcast, which Spark checks by size; beyond that both sides are dealt by task number.
    """
    rows = written(placed(scan), "numbered").withColumn("_task", F.shiftright("_place", BLOCK_BITS).cast("int"))
    blocks = rows.groupBy("_task", "_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = offsets.groupBy(F.col("_task").alias("_of")).agg(
        F.array_sort(F.collect_list(F.struct("_first", "_before"))).alias("_starts")
    )
    # The last block of the task that starts at or before the row; a task reads few blocks.
    own = F.element_at(F.filter("_starts", lambda b: b["_first"] <= F.col("_place")), -1)
    return rows.join(starts, F.col("_task") == F.col("_of")).select(
        *[F.col(f"`{c}`") for c in scan.columns], "_file", (own["_before"] + F.col("_place") - own["_first"]).alias("row_in_file")
    )


def with_chunks(scan: DataFrame, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """``numbered``, and in ``chunk_id`` the piece of ``chunk_size`` rows of its file that holds the row."""
    return numbered(scan).withColumn("chunk_id", F.floor(F.col("row_in_file") / F.lit(chunk_size)).cast("bigint"))


def map_chunks(
    chunked: DataFrame, handle: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Apply ``handle`` to every chunk, in parallel; a chunk is a pandas frame of at most ``chunk_size`` rows in file order."""

    def in_order(piece: pd.DataFrame) -> pd.DataFrame:
        return handle(piece.sort_values("row_in_file", ignore_index=True))

    return chunked.groupBy("_file", "chunk_id").applyInPandas(in_order, schema)
