"""Benchmark decontamination: training words that stand in a window of ten words of a test item.

Words are runs of digits, letters a to z (A to Z lowered) and any character beyond ASCII. Each window of an item, or the
whole item if it is shorter, is normalised to its words with single spaces. The distinct (window, item) rows are dealt to
blocks of at most some ``BLOCK_BYTES``, and each block is broadcast as a hash set: the sorted 64-bit hashes of its windows, with the
windows themselves and their items. A task hashes the words of its documents, and for each length that occurs it
looks the hashes of all windows of the document up; a hit counts once the window is the same word by word. A benchmark of usual
size is one block, so the documents are read once and not shuffled at all; beyond that they are read once a block, and only
hits are put together, by document. What is broadcast never grows with the data.

Null texts have no words. An item without words has no window. A null item_id reads as an empty one. Repeated items count
once; one item_id with several texts has the windows of all. Repeated documents are judged each by itself, a null doc_id
is passed through. A document of any length is one task's work at a time. Empty tables give clean documents, or none. Other
columns are ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, text_of, utf8
from sluicebox.scratch import written

#: Words of a window.
WIDTH = 10
#: Bytes of windows and item ids that are broadcast at once; a row counts ``ROW_BYTES`` more.
BLOCK_BYTES = 48 << 20
ROW_BYTES = 40
_KEPT_WORDS = 300_000

_U64 = np.uint64
_STEP = _U64(0x9E3779B97F4A7C15)
#: Every byte of a word, lowered; all others are gaps.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, lowered."""
    return text.translate(_NORMAL).split()


class _Hashes(dict):
    """Hashes of words; those of frequent words are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total = total * _STEP + words[i : i + n]
        total ^= total >> _U64(29)
    return total


class WindowSet:
    """The windows of a block as a hash set by length; each window has its items."""

    def __init__(self, windows: list[bytes], items: list[str]):
        of: dict[bytes, list[str]] = {}
        for window, item in zip(windows, items, strict=True):
            of.setdefault(window, []).append(item)
        hashes = _Hashes()
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for window in of:
            words = window.split()
            by_length.setdefault(len(words), []).append((int(window_hashes(hashes.of(words), len(words))[0]), window))
        self.items = of
        self.lengths = {}
        for length, rows in sorted(by_length.items()):
            rows.sort()
            self.lengths[length] = (np.array([h for h, _ in rows], dtype=np.uint64), [w for _, w in rows])

    def hits(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(first word, end, window) of every window of the set that stands in the words."""
        for length, (known, windows) in self.lengths.items():
            if len(words) < length:
                continue
            found = window_hashes(hashes, length)
            at = np.searchsorted(known, found)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == found).tolist():
                text = b" ".join(words[i : i + length])
                k = int(at[i])
                while k < len(known) and known[k] == found[i]:
                    if windows[k] == text:
                        yield i, i + length, text
                        break
                    k += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (words, item): each window, its words joined by a space, and an item that has it."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            windows, items = [], []
            for item, text in zip(batch["item"].to_pylist(), utf8(batch["text"]), strict=True):
                words = item_words(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    windows.append(b" ".join(words[i : i + width]))
                    items.append(item)
            yield {"words": windows, "item": items}

    rows = benchmark.select(text_of("item_id").alias("item"), text_of("text").alias("text"))
    return map_batches(rows, run, "words binary, item string").distinct()


def broadcast_blocks(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The windows of a benchmark as broadcast sets of bounded size; at least one.

    Blocks are dealt by a hash of window and item, so a window that many items share may stand in several blocks.
    """
    spark = benchmark.sparkSession
    windows = written(windows_of(benchmark, width), "windows")
    size = F.sum(F.octet_length("words") + F.octet_length("item") + ROW_BYTES)
    blocks = max(1, -(-(windows.agg(size).first()[0] or 0) // block_bytes))
    out = []
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == block).toArrow()
        out.append(spark.sparkContext.broadcast(WindowSet(rows["words"].to_pylist(), rows["item"].to_pylist())))
    return out


_FOUND = "row bigint, doc_id bigint, n_words bigint, spans array<struct<first: bigint, end: bigint>>, items array<string>"


def _scan(texts: DataFrame, block: Broadcast, hits_only: bool = False) -> DataFrame:
    """Spans and items of each (row, doc_id, text) for the windows of one block."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known, hashes = block.value, _Hashes()
        for batch in batches:
            out: dict[str, list] = {"row": [], "doc_id": [], "n_words": [], "spans": [], "items": []}
            for row, doc_id, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                words = item_words(text)
                spans, items = [], set()
                for first, end, window in known.hits(words, hashes.of(words)):
                    spans.append((first, end))
                    items.update(known.items[window])
                if spans or not hits_only:
                    values = (row, doc_id, len(words), [{"first": a, "end": b} for a, b in merged(spans)], sorted(items))
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            yield out

    return map_batches(texts, run, _FOUND)


def _found(texts: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """``_FOUND`` for each of ``texts`` (row, doc_id, text); rows are numbers that hold if there are several blocks."""
    if len(blocks) == 1:
        return _scan(texts, blocks[0])
    parts = [written(_scan(texts, block, k > 0), "hits") for k, block in enumerate(blocks)]
    together = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            spans = [merged([(s["first"], s["end"]) for s in x]) for x in batch["spans"].to_pylist()]
            yield batch | {"spans": [[{"first": a, "end": b} for a, b in x] for x in spans]}

    return map_batches(together, run, _FOUND)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans of hit words, sorted ids of the items that stand in it."""
    blocks = broadcast_blocks(benchmark, width, block_bytes)
    texts = docs.select(F.col("doc_id").cast("bigint"), text_of("text").alias("text"))
    if len(blocks) > 1:
        texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    else:
        texts = texts.withColumn("row", F.lit(0).cast("bigint"))
    return _found(texts, blocks).drop("row")


def report(found: DataFrame) -> DataFrame:
    """The rows of ``find`` as counts and a digest of the items."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            items = batch["items"].to_pylist()
            hit = [sum(s["end"] - s["first"] for s in spans) for spans in batch["spans"].to_pylist()]
            yield {
                "doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_hit": hit, "n_items": list(map(len, items)),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                "contaminated": [n > 0 for n in hit],
            }

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return map_batches(found, run, schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans of its words; what stands between two words goes with the words on its either side."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


REMOVED = ("spans", "documents")


def clean(
    docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without the hit spans, or without the documents that have any; ``n_chars`` follows the text where it exists.

    Only contaminated documents are looked up by row number; the others pass as they are.
    """
    if remove not in REMOVED:
        raise ValueError(f"unknown choice {remove!r}: use one of {', '.join(REMOVED)}")
    packed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = written(packed, "documents")
    texts = rows.select("row", F.col("doc")["doc_id"].cast("bigint").alias("doc_id"), text_of(F.col("doc")["text"]).alias("text"))
    found = _found(texts, broadcast_blocks(benchmark, width, block_bytes)).where(F.size("spans") > 0)
    hit = found.select(F.col("row").alias("of"), "spans")
    if remove == "documents":
        return rows.join(hit, F.col("row") == F.col("of"), "left_anti").select("doc.*")

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None else without_spans(t, [(x["first"], x["end"]) for x in s]))

    joined = rows.join(hit, F.col("row") == F.col("of"), "left").withColumn("hit", F.col("spans").isNotNull())
    text = F.when(F.col("hit"), cut(F.col("doc")["text"].cast("string"), F.col("spans"))).otherwise(F.col("doc")["text"])
    changed = joined.select("doc", "hit", text.alias("cut"))
    out = []
    for field in docs.schema.fields:
        value = F.col("doc")[field.name]
        if field.name == "text":
            value = F.col("cut")
        elif field.name == "n_chars":
            value = F.when(F.col("hit"), F.length("cut").cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return changed.select(*out)
