"""A folder read a few files at a time, with quality rules on each piece.

The pieces are micro-batches of a bounded file stream. Progress is kept in a checkpoint folder, so a restarted run
goes on where it stopped. Each piece is written under its batch number, so a repeated piece replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluicebox.operators.rules import RowRule, row_counts

Handler = Callable[[DataFrame, int], None]


@contextmanager
def _held(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """``settings`` hold inside; a stream keeps those it was started with."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def each_piece(
    spark: SparkSession, folder: str, schema: T.StructType | str, handler: Handler, checkpoint: str,
    file_format: str = "csv", files_per_piece: int = 1, options: dict[str, object] | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None, output_mode: str = "append", settings: Mapping[str, str] | None = None,
) -> None:
    """Hand every file of ``folder`` to ``handler(piece, number)``, ``files_per_piece`` files at a time.

    ``shape`` may turn the stream into another one first, with state that is kept from piece to piece. ``settings`` are those
    of the session for this stream alone; of a stream that goes on, Spark takes the buckets and provider of its state from the checkpoint.
    """
    stream = (
        spark.readStream.format(file_format)
        .schema(schema)
        .options(**(options or {}))
        .option("maxFilesPerTrigger", files_per_piece)
        .load(folder)
    )
    writer = (
        (shape(stream) if shape else stream)
        .writeStream.foreachBatch(handler)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with _held(spark, settings or {}):
        query = writer.start()
    query.awaitTermination()


def check_folder(
    spark: SparkSession, folder: str, schema: T.StructType | str, rules: Sequence[RowRule], out: str, checkpoint: str,
    **read: object,
) -> DataFrame:
    """Count rows and violations of each piece of a folder; returns one row per piece and rule."""

    def handle(piece: DataFrame, number: int) -> None:
        row_counts(piece, rules).write.mode("overwrite").parquet(f"{out}/piece={number}")

    each_piece(spark, folder, schema, handle, checkpoint, **read)
    return spark.read.parquet(out)
