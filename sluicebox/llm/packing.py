"""Best-fit packing of documents into bins of equal capacity, under conflicts.

A bin never holds two documents of one source or of one duplicate cluster. A text longer than a bin fills bins by
itself, and its last piece is packed like a shorter document. Pieces are placed from the longest to the shortest: bins
are ordered by what is left in them, each carries a bitmap of its sources and one of its clusters, and the search
goes from the least sufficient rest to the next one until a bin without a conflict is found, the tightest that there is; a
new bin is opened only when there is none. Bins of equal rest and equal bitmaps are tried once, and rests in which every
bin has the document's (frequent) source are skipped by counts, so a source or a cluster with most of the rows does
not make the search long.

The documents are dealt by a hash of doc_id and content to shards of some ``SHARD_ROWS``, which are packed
independently: memory is bounded by a shard's numbers (texts are not shuffled), and a hot source or group of copies is
spread over all shards. A shard is one deterministic function of its rows.

Lengths are code points. Null and empty texts are pieces of length 0. A null source is a source of its own, and so is
the cluster of each text (equal up to case and white space); rows that repeat a document are copies, so they go to
different bins. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import GAP, map_batches, text_of
from sluicebox.scratch import written

CAPACITY = 8192
SHARD_ROWS = 20_000
#: A source with so many pieces in a shard gets counts of its own.
FREQUENT = 100

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, bin bigint, place bigint"


class Bins:
    """The bins of one shard, ordered by rest."""

    def __init__(self, capacity: int, frequent: list[int]):
        self.capacity = capacity
        self.rest: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        # Rest -> (source bitmap, cluster bitmap) -> heap of bins.
        self.at: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        # Bins at each rest: all of them (row 0), and those without each frequent source.
        self.row = {source: i + 1 for i, source in enumerate(frequent)}
        self.masks = [0, *[1 << source for source in frequent]]
        self.counts = np.zeros((len(self.masks), capacity + 1), dtype=np.int64)

    def _count(self, rest: int, sources: int, change: int) -> None:
        for i, mask in enumerate(self.masks):
            if not sources & mask:
                self.counts[i, rest] += change

    def _enter(self, number: int) -> None:
        rest, key = self.rest[number], (self.sources[number], self.clusters[number])
        heapq.heappush(self.at[rest].setdefault(key, []), number)
        self._count(rest, key[0], 1)

    def _find(self, length: int, source: int, clusters: int) -> int | None:
        """The tightest bin without a conflict, the oldest among equals; taken out of the order."""
        counts = self.counts[self.row.get(source, 0)]
        own = 1 << source
        rest = length
        while True:
            ahead = counts[rest:] > 0
            step = int(ahead.argmax())
            if not ahead[step]:
                return None
            rest += step
            fits = [(bins[0], key) for key, bins in self.at[rest].items() if not key[0] & own and not key[1] & clusters]
            if fits:
                number, key = min(fits)
                heapq.heappop(self.at[rest][key])
                if not self.at[rest][key]:
                    del self.at[rest][key]
                self._count(rest, key[0], -1)
                return number
            rest += 1
            if rest > self.capacity:
                return None

    def place(self, length: int, source: int, clusters: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin, or a new one: (bin, place in it)."""
        number = self._find(length, source, clusters)
        if number is None:
            number = self.open()
        offset = self.capacity - self.rest[number]
        self.rest[number] -= length
        self.sources[number] |= 1 << source
        self.clusters[number] |= clusters
        self._enter(number)
        return number, offset

    def open(self, full: bool = False) -> int:
        self.rest.append(0 if full else self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.rest) - 1


def pack_shard(lengths: np.ndarray, sources: list, clusters: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, piece, start, length, bin, place) of all pieces; rows come from the longest last piece to the shortest."""
    numbers = {name: i for i, name in enumerate(dict.fromkeys(sources))}
    own = [numbers[name] for name in sources]
    times = np.bincount(own, minlength=len(numbers)) if own else np.zeros(0)
    bins = Bins(capacity, np.flatnonzero(times >= FREQUENT).tolist())
    names, group, size = np.unique(clusters, return_inverse=True, return_counts=True)
    shared = {int(g): 1 << i for i, g in enumerate(np.flatnonzero(size > 1))}  # a cluster of one cannot conflict
    for row, (length, source) in enumerate(zip(lengths.tolist(), own, strict=True)):
        whole, last = divmod(length, capacity)
        if whole and not last:
            whole, last = whole - 1, capacity
        for piece in range(whole):
            yield row, piece, piece * capacity, capacity, bins.open(full=True), 0
        number, place = bins.place(last, source, shared.get(int(group[row]), 0))
        yield row, whole, whole * capacity, last, number, place


def cluster_of(text: str) -> Column:
    """Texts that differ in case and white space only are copies."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text_of(text)), GAP, " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin, place. Together the pieces of a document are its text."""
    rows = written(docs.select(
        "doc_id", F.length(text_of("text")).cast("bigint").alias("length"), F.col("source").cast("string").alias("source"),
        (cluster_of("text") if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    ), "lengths")
    shards = max(1, math.ceil(rows.count() / shard_rows))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple] = []
        shard = None

        def packed() -> Iterator[dict]:
            ids, lengths, sources, clusters = zip(*held, strict=True)
            pieces = pack_shard(np.array(lengths, dtype=np.int64), list(sources), np.array(clusters, dtype=np.int64), capacity)
            out = [(ids[row], piece, start, length, (shard << 40) | number, place) for row, piece, start, length, number, place in pieces]
            yield dict(zip(("doc_id", "piece", "start", "length", "bin", "place"), zip(*out, strict=True), strict=True))

        for batch in batches:
            for number, *values in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "length", "source", "cluster")), strict=True):
                if held and number != shard:
                    yield from packed()
                    held.clear()
                shard = number
                held.append(tuple(values))
        if held:
            yield from packed()

    last = F.when(F.col("length") > 0, F.pmod(F.col("length") - 1, F.lit(capacity)) + 1).otherwise(F.lit(0))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("bigint")).withColumn("last", last)
    order = ["shard", F.desc("last"), "doc_id", "cluster", "source"]
    return map_batches(dealt.repartition(F.col("shard")).sortWithinPartitions(*order).drop("last"), run, _PIECES)


def sequences(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed texts: (bin, place, doc_id, piece, text), for tables whose doc_id is unique."""
    texts = docs.select(F.col("doc_id").alias("of"), text_of("text").alias("whole"))
    joined = pieces.join(texts, F.col("doc_id").eqNullSafe(F.col("of")))
    cut = F.substring(F.col("whole"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return joined.select("bin", "place", "doc_id", "piece", cut.alias("text"))
