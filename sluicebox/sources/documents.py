"""JSON documents of any size, an array or an object of records, read by all tasks.

A document is cut at closing braces, of which every record has one, whatever its line breaks. A piece may begin outside of
strings, inside, or inside after a backslash: a block of pieces is a function of these three states that also says how
the depth of brackets changes, how low it gets, and how often. Put together in file order these give the state and depth at the
start of each block. A record ends where a closing brace brings the depth back to that between records.

A document is whole if its brackets close once, at its end. The text of any other comes as it is, a row a block of input, so one
that fits a block is one row. In a whole document each record is judged by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicebox.scratch import written
from sluicebox.sources import blocks

OUTSIDE, STRING, ESCAPED = range(3)
WHOLE, HEAD, MIDDLE, TAIL, BROKEN = range(5)

_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.S)
_REST = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
_CLOSING = re.compile(rb"[\[{\]]")
_BOM = b"\xef\xbb\xbf"
_BLANK = b" \t\r\n"
_ABOVE = 1 << 40  # no closing bracket so far


def lex(piece: bytes, state: int) -> tuple[int, int, int, int]:
    """(state after, change of depth, lowest depth after a closing bracket, how often) of a piece without closing braces."""
    at = 0
    if state != OUTSIDE:
        end = _REST.match(piece, at + (state == ESCAPED))
        if end is None:
            return _open_end(piece[state == ESCAPED :]) if piece or state == STRING else ESCAPED, 0, _ABOVE, 0
        at = end.end()
    plain = _STRING.sub(b"", piece[at:]) if b'"' in piece[at:] else piece[at:]
    plain, quote, rest = plain.partition(b'"')
    after = _open_end(rest) if quote else OUTSIDE
    if b"]" not in plain:
        return after, plain.count(b"{") + plain.count(b"["), _ABOVE, 0
    depth, low, times = 0, _ABOVE, 0
    for bracket in _CLOSING.findall(plain):
        if bracket == b"]":
            depth -= 1
            low, times = (depth, 1) if depth < low else (low, times + (depth == low))
        else:
            depth += 1
    return after, depth, low, times


def _open_end(text: bytes) -> int:
    """The state at the end of text in a string."""
    return ESCAPED if (len(text) - len(text.rstrip(b"\\"))) % 2 else STRING


class _Depth:
    """State, depth, lowest depth and how often, from one start state on."""

    def __init__(self, state: int):
        self.state, self.depth, self.low, self.times = state, 0, _ABOVE, 0

    def _lower(self, low: int, times: int) -> None:
        if low < self.low:
            self.low, self.times = low, times
        elif low == self.low:
            self.times += times

    def text(self, piece: bytes) -> None:
        self.state, change, low, times = lex(piece, self.state)
        self._lower(self.depth + low, times)
        self.depth += change

    def brace(self) -> bool:
        """A closing brace; does it close anything?"""
        if self.state != OUTSIDE:
            self.state = STRING
            return False
        self.depth -= 1
        self._lower(self.depth, 1)
        return True


class _Block:
    """The summary of a block: the brace after its last piece is left to whoever knows whether the file goes on."""

    def __init__(self):
        self.starts = [_Depth(state) for state in (OUTSIDE, STRING, ESCAPED)]
        self.size, self.opener, self.begun = 0, "", False

    def add(self, piece: bytes) -> None:
        for start in self.starts:
            if self.begun:
                start.brace()
            start.text(piece)
        if not self.opener:
            self.opener = piece.removeprefix(_BOM).lstrip(_BLANK)[:1].decode("latin-1")
        self.size, self.begun = self.size + len(piece) + 1, True

    def row(self) -> tuple:
        return self.size, self.opener, [s.state for s in self.starts], [s.depth for s in self.starts], [s.low for s in self.starts], [s.times for s in self.starts]


_SUMMARY = {
    "size": "bigint", "opener": "string", "states": "array<int>", "depths": "array<bigint>", "lows": "array<bigint>", "times": "array<bigint>",
}


def _composed(rows: Sequence, closed: bool) -> tuple[_Depth, list[tuple]]:
    """The end of a file, and state and depth at the start of each of its blocks; ``closed``: it ends with a brace."""
    at, places = _Depth(OUTSIDE), []
    for row in rows:
        places.append((at.state, at.depth))
        at._lower(at.depth + row["lows"][at.state], row["times"][at.state])
        at.depth, at.state = at.depth + row["depths"][at.state], row["states"][at.state]
        if closed or row is not rows[-1]:
            at.brace()
    return at, places


def _starts(rows: Sequence, openers: str) -> dict[int, tuple]:
    """How each block is to be read, from the summaries of all blocks in file order."""
    starts: dict[int, tuple] = {}
    by_file: dict[str, list] = {}
    for row in rows:
        by_file.setdefault(row["file"], []).append(row)
    for file, own in by_file.items():
        # A file that ends with a brace has no piece after it. A mark at its start is not in the pieces; if it is packed, try both.
        missing = own[0]["length"] - sum(row["size"] for row in own)
        opener = next((row["opener"] for row in own if row["opener"]), " ")
        base = 1 if opener in openers[1:] else 0
        for closed in [True] if missing in (0, 3) else [False] if missing in (-1, 2) else [True, False]:
            at, places = _composed(own, closed)
            whole = opener in openers.strip() and (at.state, at.depth, at.low, at.times) == (OUTSIDE, 0, 0, 1)
            if whole:
                break
        for row, (state, depth) in zip(own, places, strict=True):
            starts[row["key"]] = (file, row["block"], whole, base, state, depth, closed or row is not own[-1])
    return starts


class _Records:
    """(file, block, place, kind, text): the records of a block; one that crosses blocks is a TAIL, any MIDDLE, and a HEAD."""

    def __init__(self, file: str, block: int, whole: bool, base: int, state: int, depth: int, closed: bool):
        self.place, self.whole, self.base, self.closed = [file, block, 0], whole, base, closed
        self.at = _Depth(state)
        self.at.depth = depth
        self.crosses = block > 0 and not (state == OUTSIDE and depth <= base)
        self.first, self.begun, self.held = block == 0, False, []

    def _row(self, kind: int, text: bytes) -> Iterator[tuple]:
        if kind in (WHOLE, TAIL, BROKEN) and self.first:
            self.first = False
            if kind != BROKEN:
                text = text.removeprefix(_BOM).lstrip(_BLANK)[self.base :]
        if kind != WHOLE or text.strip(_BLANK + b","):
            yield *self.place, kind, text
            self.place[2] += 1

    def _brace(self) -> Iterator[tuple]:
        """The brace after the piece that was added last."""
        if self.at.brace() and self.whole and self.at.depth <= self.base:
            # Below the depth between records it is the document's own.
            text = b"}".join(self.held) + (b"}" if self.at.depth == self.base else b"")
            yield from self._row(HEAD if self.crosses else WHOLE, text)
            self.held, self.begun, self.crosses = [], False, False

    def add(self, piece: bytes) -> Iterator[tuple]:
        if self.begun:
            yield from self._brace()
        self.at.text(piece)
        self.held.append(piece)
        self.begun = True

    def close(self) -> Iterator[tuple]:
        if self.whole and self.closed:
            yield from self._brace()
        if self.begun:
            text = b"}".join(self.held) + (b"}" if self.closed else b"")
            if not self.whole:
                yield from self._row(BROKEN, text)
            elif not self.closed:  # the end of the file: what is left behind the last record, and the end of an array
                end = text.rstrip(_BLANK)
                yield from self._row(HEAD if self.crosses else WHOLE, end.removesuffix(b"]") if self.base else end)
            else:
                yield from self._row(MIDDLE if self.crosses else TAIL, text)


_ROW = "file string, block bigint, place int, kind int, text binary"


def records(spark: SparkSession, path: str | Sequence[str], openers: str, encoding: str) -> DataFrame:
    """(file, block, place, record, broken) of all documents, written down; the first three give the order.

    ``openers``: the bracket of a document that is one record, or a blank, and the bracket around records. A record comes without the
    comma before it; what stands behind the last one and is no object comes as one more. ``broken`` marks the text of documents that are not whole.
    """
    if blocks.ascii_based(encoding):
        pieces = blocks.scan(spark, path, "}")
    else:
        pieces, encoding = _decoded(spark, path, encoding), "utf-8"
    starts = _starts(blocks.summaries(pieces, _Block, _SUMMARY), openers)
    found = written(blocks.records(pieces, starts, _Records, _ROW), "records")
    crossing = found.where(F.col("kind").isin(HEAD, MIDDLE, TAIL))
    earlier = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most two short rows a block: the number of records begun in blocks so far says which pieces belong together.
    numbers = crossing.select("file", "block", "kind", F.sum((F.col("kind") == TAIL).cast("int")).over(earlier).alias("number"))
    parts = crossing.join(numbers, ["file", "block", "kind"]).groupBy("file", "number").agg(
        F.min("block").alias("first"), F.min_by("place", "block").alias("place"),
        F.array_sort(F.collect_list(F.struct("block", F.hex("text").alias("text")))).alias("parts"),
    )
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    whole = found.where(F.col("kind").isin(WHOLE, BROKEN)).select("file", "block", "place", "text", (F.col("kind") == BROKEN).alias("broken"))
    every = whole.unionByName(parts.select("file", F.col("first").alias("block"), "place", joined.alias("text"), F.lit(False).alias("broken")))
    text = F.decode("text", encoding)
    bare = F.regexp_replace(text, r"^[ \t\r\n]*,", "")
    return every.select("file", "block", "place", F.when(F.col("broken"), text).otherwise(bare).alias("record"), "broken")


def _decoded(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame:
    """The pieces of files in an encoding that cannot be cut at a byte: one task a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = files.select(F.col("path").alias("file"), F.lit(0).cast("bigint").alias("block"), F.decode("content", encoding).alias("text"))
    pieces = F.explode(F.split("text", r"\}")).alias("piece")
    placed = text.select("file", F.octet_length("text").cast("bigint").alias("length"), "block", pieces)
    return placed.select("file", "length", "block", F.xxhash64("file", "block").alias("key"), F.col("piece").cast("binary"))
