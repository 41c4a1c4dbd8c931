"""Records of delimited text with line breaks inside quotes, found by all tasks in one large file.

A line either begins outside of quotes or inside of them, so a block of lines is a function of two states, and functions are put
together in file order (where all quotes are balanced that is a prefix of exclusive ors over their parity). Quotes count only where
a cell begins with one; doubled quotes inside are text; what follows a closing quote up to the delimiter is plain. In a
file whose first line ends with two bytes, line breaks of two bytes inside of quotes become one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.sources import blocks

_CLOSED = re.compile(rb'(?:[^"]|"")*+"')
_BOM = b"\xef\xbb\xbf"


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Is the end of the line inside of quotes, if its start is as given?"""
    at = 0
    while True:
        if not inside and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        if inside:
            closed = _CLOSED.match(line, at)
            if closed is None:
                return True
            inside, at = False, closed.end()
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += len(delimiter)
        if line.find(b'"', at) < 0:
            return False


class _Quotes:
    """For a block that begins outside, and one that begins inside of quotes: where it ends, and the records that begin in it."""

    def __init__(self, delimiter: bytes):
        self.delimiter = delimiter
        self.inside, self.begun = [False, True], [0, 0]
        self.two: bool | None = None

    def add(self, line: bytes) -> None:
        if self.two is None:
            self.two = line.endswith(b"\r")
        quoted = b'"' in line
        for start in (0, 1):
            if not self.inside[start]:
                self.begun[start] += line not in (b"", b"\r")
            if quoted:
                self.inside[start] = ends_inside(line, self.inside[start], self.delimiter)

    def row(self) -> tuple:
        return self.two, self.inside[0], self.begun[0], self.inside[1], self.begun[1]


class _Records:
    """(position, whole, block, record) of a block; a record that crosses blocks gives a piece in each."""

    def __init__(self, delimiter: bytes, block: int, two: bool, inside: bool, number: int, skip: int, before: int):
        self.delimiter, self.block, self.two, self.inside = delimiter, block, two, inside
        self.number, self.skip, self.before = number - inside, skip, before
        self.crosses, self.first = inside, block == 0
        self.held: list[bytes] = []

    def _record(self, whole: bool) -> Iterator[tuple]:
        text = b"\n".join(self.held)
        if not self.inside:  # the separator that ends a record may be two bytes
            text = text.removesuffix(b"\r")
        if self.number >= self.skip:
            yield self.before + self.number - self.skip, whole, self.block, text
        self.held = []

    def add(self, line: bytes) -> Iterator[tuple]:
        if self.first:
            self.first, line = False, line.removeprefix(_BOM)
        if not self.inside and line in (b"", b"\r"):
            return
        if self.two:
            line = line.removesuffix(b"\r")
        self.held.append(line)
        if b'"' in line:
            self.inside = ends_inside(line, self.inside, self.delimiter)
        if not self.inside:
            yield from self._record(not self.crosses)
            self.crosses = False
            self.number += 1

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._record(False)


def _starts(rows: Sequence, mark: bytes, skip: int) -> dict[int, tuple]:
    """How each block is to be read, from the summaries of all blocks in file order."""
    starts: dict[int, tuple] = {}
    file, two, inside, number, before = None, False, False, 0, 0
    for row in rows:
        if row["file"] != file:
            before += max(0, number - skip)
            file, two, inside, number = row["file"], row["two"], False, 0
        starts[row["key"]] = (mark, row["block"], two, inside, number, skip, before)
        number += row["begun_1" if inside else "begun_0"]
        inside = row["inside_1" if inside else "inside_0"]
    return starts


_SUMMARY = {"two": "boolean", "inside_0": "boolean", "begun_0": "bigint", "inside_1": "boolean", "begun_1": "bigint"}


def quoted_records(
    spark: SparkSession, path: str | Sequence[str], delimiter: str, encoding: str, skip: int
) -> DataFrame:
    """(position, record): the records of all files but the first ``skip`` of each, numbered by file and place; empty lines are none.

    The position costs nothing more, so the first rows or rows of a page are a filter.
    """
    mark = delimiter.encode(encoding)
    pieces = blocks.scan(spark, path, "\n")
    starts = _starts(blocks.summaries(pieces, lambda: _Quotes(mark), _SUMMARY), mark, skip)
    found = blocks.records(pieces, starts, _Records, "position bigint, whole boolean, block bigint, record binary")
    crossing = found.where("NOT whole").groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("block", F.decode("record", encoding).alias("text")))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    whole = found.where("whole").select("position", F.decode("record", encoding).alias("record"))
    return whole.unionByName(crossing.select("position", joined.alias("record")))
