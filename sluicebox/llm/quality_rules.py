"""Quality rules: base statistics of a text, and lines that recur across the documents of a host.

Lines are normalised (A-Z lowered, digits to 0, runs of separators to one space, trimmed) and hashed to 60 bits; per
host, the distinct documents of every line are counted. A line found in more than ``limit`` documents of its host is
removed, and a document that loses more than ``max_lost`` of its words to that is depleted and rejected.

Documents of one and the same text count once, and so does a family of near copies, so that no group of copies pushes its
own lines over the limit. Families are the components of near_dedup among the texts that would lose more than
``FAMILY_LOST_PERCENT`` of their words if texts were counted; near copies share more than that. This is one rule for lines of all
lengths. The host is the ``source`` column.

Plan: one Arrow pass over the texts writes the statistics and the lines' hashes (some 20 bytes a line) to the shared
folder; the counts are distinct aggregations with partial results in each task, so a line that a third of all
documents share is one row a task; the frequent lines then meet the lines again in a join whose small side adaptive
execution broadcasts only if it is small, and whose hot keys it splits. Only the texts that lose much are read a second
time, by near_dedup, and only the lines found frequent are counted again.

Null and empty texts have zero words and fail the base rules. A null source is a host of its own. Repeated rows are
judged each by itself. An empty table gives an empty result. Other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm import near_dedup
from sluicebox.llm.common import map_batches, numbered, text_of, utf8
from sluicebox.scratch import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line may stand in so many distinct documents of one host.
LINE_LIMIT = 10
#: A document may lose this percentage of its words.
MAX_LOST_PERCENT = 75
#: Texts that would lose more than this percentage are compared, and near copies among them count once;
FAMILY_LOST_PERCENT = 25
#: near copies by words of a shingle, and percent of shingles in common. That is above what a depleted document may have
#: of its own, so documents of boilerplate with a few own sentences are no family and are rejected.
FAMILY_SHINGLE = 2
FAMILY_PERCENT = 95

_SYMBOLS = b"#*$%&|<>"
_GAPS = b" \t\n\v\f\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_ZEROS = re.compile(rb"0+")

# Class of a byte: 0 within a code point, 1 separator, 2 symbol, 3 first byte of any other code point.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[list(_GAPS)] = 1
_CLASS[list(_SYMBOLS)] = 2

_SCHEMA = (
    "doc_id bigint, host string, content binary, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, lines array<struct<line: bigint, words: bigint>>"
)
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = numbered(words)
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    triples = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, place, times = np.unique(triples, return_inverse=True, return_counts=True)
    found = times[place] > 1
    covered = np.zeros(n, dtype=bool)
    covered[: n - 2] |= found
    covered[1 : n - 1] |= found
    covered[2:] |= found
    return int(covered.sum())


def normal_line(line: bytes) -> bytes:
    return _ZEROS.sub(b"0", b" ".join(line.translate(_LOWER).split()))


def line_hash(line: bytes) -> int:
    """60 bits of the MD5 of a normalised line."""
    return int(hashlib.md5(line, usedforsecurity=False).hexdigest()[:15], 16)


def text_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=4)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(words), int(kinds[2] + kinds[3]), int(kinds[2]), len(lines) - len(set(lines)), repeated_words(words)


def text_lines(text: bytes) -> list[dict]:
    """The distinct normalised lines of a text: hash, and words in all their copies."""
    words: dict[int, int] = {}
    for line in text.split(b"\n"):
        normal = normal_line(line)
        if normal:
            key = line_hash(normal)
            words[key] = words.get(key, 0) + normal.count(b" ") + 1
    return [{"line": k, "words": n} for k, n in words.items()]


def _judged(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        texts = utf8(batch["text"])
        out = dict(zip(_BASE, map(list, zip(*map(text_statistics, texts), strict=True)), strict=True))
        out |= {"doc_id": batch["doc_id"].to_pylist(), "host": batch["host"].to_pylist(), "content": batch["content"].to_pylist()}
        yield out | {"lines": [text_lines(t) for t in texts]}


def statistics(docs: DataFrame) -> DataFrame:
    """Written rows of statistics and lines, one per document, numbered by ``row``."""
    texts = docs.select(
        "doc_id", F.col("source").cast("string").alias("host"), text_of("text").alias("text"),
        F.unhex(F.md5(text_of("text"))).alias("content"),
    )
    return written(map_batches(texts, _judged, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "lines")


def _recurring(lines: DataFrame, known_by: str, limit: int) -> DataFrame:
    """(host, line, n_documents) of lines with more than ``limit`` different values of ``known_by`` in their host."""
    ones = lines.groupBy("host", "line", known_by).agg(F.lit(1).alias("one"))
    return ones.groupBy("host", "line").agg(F.count("one").alias("n_documents")).where(F.col("n_documents") > limit)


def frequent_lines(docs: DataFrame, rows: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, line, n_documents) of lines in more than ``limit`` distinct documents of their host; a family of near copies is one."""
    lines = rows.select("host", "content", F.inline("lines"))
    often = written(_recurring(lines, "content", limit), "frequent")
    families = written(_families(docs, rows, often), "families")
    if families.isEmpty():
        return often
    found = often.select(F.col("host").alias("of"), F.col("line").alias("at"))
    same = lines["host"].eqNullSafe(found["of"]) & (lines["line"] == found["at"])
    held = lines.join(found, same, "left_semi").select("host", "line", "content").distinct()
    counted = held.join(families, F.col("content") == F.col("known"), "left")
    # The number of a family, or what no family has: the text's digest.
    return _recurring(counted.withColumn("document", F.coalesce(F.col("family").cast("string"), F.hex("content"))), "document", limit)


def _families(docs: DataFrame, rows: DataFrame, often: DataFrame) -> DataFrame:
    """(known, family) of the texts that would lose much, where another one is a near copy."""
    lost = rows.join(_losses(rows, often), F.col("row") == F.col("loser"))
    much = lost.where(100 * F.col("lost_words") > FAMILY_LOST_PERCENT * F.col("n_words"))
    contents = much.select(F.col("content").alias("known")).distinct()
    contents = written(contents.withColumn("doc_id", F.monotonically_increasing_id()), "contents")
    if contents.isEmpty():
        return contents.select("known", F.col("doc_id").alias("family"))
    texts = docs.select(text_of("text").alias("text")).join(contents, F.unhex(F.md5("text")) == F.col("known"))
    alike = near_dedup.deduplicate(texts.select("doc_id", "text"), FAMILY_SHINGLE, FAMILY_PERCENT)
    return contents.join(alike.select("doc_id", F.col("component_id").alias("family")).distinct(), "doc_id").select("known", "family")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _losses(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, removed lines, words lost) of the documents that lose lines."""
    both = rows.select("row", "host", F.inline("lines"))
    lines = both.select("row", F.col("host").alias("of"), F.col("line").alias("at"), "words")
    hit = lines.join(frequent, lines["of"].eqNullSafe(frequent["host"]) & (lines["at"] == frequent["line"]))
    return hit.groupBy(F.col("row").alias("loser")).agg(
        F.collect_list("line").alias("removed"), F.sum("words").alias("lost_words"), F.count("line").alias("n_removed_lines")
    )


def _decided(docs: DataFrame, limit: int, max_lost: int) -> DataFrame:
    rows = statistics(docs)
    losses = _losses(rows, frequent_lines(docs, rows, limit))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    lost = F.coalesce("lost_words", F.lit(0)).cast("bigint")
    return rows.join(losses, rows["row"] == losses["loser"], "left").select(
        "doc_id", "host", "content", *_BASE, failed.alias("base_failed"),
        (~failed & (100 * lost <= max_lost * F.col("n_words"))).alias("kept"),
        F.coalesce("n_removed_lines", F.lit(0)).cast("bigint").alias("n_removed_lines"), lost.alias("lost_words"), "removed",
    )


def judge(docs: DataFrame, limit: int = LINE_LIMIT, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per document: the base statistics, base_failed, kept, and what the line rule takes away."""
    return _decided(docs, limit, max_lost).select("doc_id", *_BASE, "base_failed", "kept", "n_removed_lines", "lost_words")


def without_lines(text: str | None, removed: set[int]) -> str | None:
    if text is None:
        return None
    def stays(line: str) -> bool:
        normal = normal_line(line.encode())
        return not normal or line_hash(normal) not in removed

    return "\n".join(filter(stays, text.split("\n")))


def clean(docs: DataFrame, limit: int = LINE_LIMIT, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """The documents that stay, without the lines above the limit; ``n_chars`` follows the text where it exists."""
    decided = _decided(docs, limit, max_lost)
    judged = decided.select(
        F.col("doc_id").alias("id"), F.col("host").alias("h"), F.col("content").alias("c"), "kept", F.col("removed").alias("gone")
    ).where("NOT kept OR gone IS NOT NULL").dropDuplicates(["id", "h", "c"])
    packed = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").alias("of"), F.col("source").cast("string").alias("host"),
        F.unhex(F.md5(text_of("text"))).alias("content"),
    )
    same = packed["of"].eqNullSafe(judged["id"]) & packed["host"].eqNullSafe(judged["h"]) & (packed["content"] == judged["c"])
    stays = packed.join(judged, same, "left").where("kept IS NULL OR kept")

    @F.pandas_udf("string")
    def cut(texts, gone):
        return texts.combine(gone, lambda t, g: t if g is None else without_lines(t, set(g)))

    text = F.when(F.col("gone").isNull(), F.col("doc")["text"]).otherwise(cut(F.col("doc")["text"], F.col("gone")))
    changed = stays.select("doc", text.alias("cut"), F.col("gone").isNotNull().alias("shorter"))
    out = [
        F.col("cut").alias("text") if c == "text"
        else F.when(F.col("shorter"), F.length("cut").cast(docs.schema[c].dataType)).otherwise(F.col("doc")[c]).alias(c) if c == "n_chars"
        else F.col("doc")[c].alias(c)
        for c in docs.columns
    ]
    return changed.select(*out)
