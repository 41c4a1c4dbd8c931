"""Large text files read by all tasks, where what a byte means depends on everything before it.

A file is scanned in blocks, which Spark cuts at a separator that is a single byte. A first scan gives one small row a
block: what an automaton does to each state in which the block might begin. These rows, put together in file order, fix the
state at the start of every block; a second scan reads each block from there, and records that cross blocks are joined from their pieces.

The driver holds some 100 bytes a block while it does this. It holds more than that for every block of a scan anyway, as
blocks are what it deals to tasks; so this grows with the scan's own bookkeeping and never with records.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in which a byte below 128 always is that ASCII character.
_ASCII_BASED = ("utf-8", "ascii", "iso8859", "cp125", "koi8", "latin")


def ascii_based(encoding: str) -> bool:
    """Can files of this encoding be cut at a byte?"""
    try:
        return codecs.lookup(encoding).name.startswith(_ASCII_BASED)
    except LookupError:
        return False


def scan(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(file, length, block, key, piece): the text between separators as bytes; length is the file's, key stands for file and block."""
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", separator).text(path)
    placed = text.select(
        F.input_file_name().alias("file"), F.col("_metadata.file_size").alias("length"), F.input_file_block_start().alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )
    return placed.select("file", "length", "block", F.xxhash64("file", "block").alias("key"), "piece")


class Summary(Protocol):
    """What a block does to each start state."""

    def add(self, piece: bytes) -> None: ...

    def row(self) -> tuple: ...


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """(key, first row, end, batch) of the runs of one block, in scan order."""
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("key").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for first, end in zip(bounds[:-1], bounds[1:], strict=True):
                yield int(keys[first]), first, end, batch


def summaries(pieces: DataFrame, fresh: Callable[[], Summary], columns: Mapping[str, str]) -> list:
    """One row a block, in file order: file, length, block, key and the ``columns`` of its summary."""
    own = ["file", "length", "block"]
    schema = "file string, length bigint, block bigint, key bigint, " + ", ".join(f"{name} {kind}" for name, kind in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, summary = None, None, None

        def row() -> pa.RecordBatch:
            values = [*place, current, *summary.row()]
            return pa.RecordBatch.from_pylist([dict(zip([*own, "key", *columns], values, strict=True))], schema=arrow)

        for key, first, end, batch in _blocks(batches):
            if key != current:
                if summary is not None:
                    yield row()
                current, place, summary = key, [batch.column(c)[first].as_py() for c in own], fresh()
            for piece in batch.column("piece")[first:end].to_pylist():
                summary.add(piece)
        if summary is not None:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return sorted(pieces.mapInArrow(run, schema).collect(), key=lambda r: (r["file"], r["block"]))


class Reader(Protocol):
    """Reads a block from its start state; gives rows of the output."""

    def add(self, piece: bytes) -> Iterator[tuple]: ...

    def close(self) -> Iterator[tuple]: ...


_ROWS, _BYTES = 10_000, 8 << 20


def records(pieces: DataFrame, starts: Mapping[int, tuple], reader: Callable[..., Reader], schema: str) -> DataFrame:
    """What ``reader(*starts[key])`` makes of each block. ``schema`` ends with the text of a row.

    A block that the first scan did not see is an error: then files were changed in between.
    """
    known = pieces.sparkSession.sparkContext.broadcast(dict(starts))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            arrays = [pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def found() -> Iterator[tuple]:
            current, block = None, None
            for key, first, end, batch in _blocks(batches):
                if key != current:
                    if block is not None:
                        yield from block.close()
                    if key not in known.value:
                        raise ValueError("a file was changed while it was read")
                    current, block = key, reader(*known.value[key])
                for piece in batch.column("piece")[first:end].to_pylist():
                    yield from block.add(piece)
            if block is not None:
                yield from block.close()

        for row in found():
            rows.append(row)
            size += len(row[-1])
            if len(rows) >= _ROWS or size >= _BYTES:
                yield packed()
                rows, size = [], 0
        if rows:
            yield packed()

    return pieces.select("key", "piece").mapInArrow(run, schema)
