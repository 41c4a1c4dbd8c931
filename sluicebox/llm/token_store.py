"""Token ids in compressed files, and their reading.

Texts are put into ranges of doc_id (the ranges are found from the keys alone, before anything is encoded), and each task
encodes the texts of its range in order and writes the ids as blocks of whole documents (some ``BLOCK`` ids) coded by ``rans``; the blocks of a segment share
one frequency table, made from all of the segment's ids. A block stands in one row of a Parquet dataset that Spark
writes (so a lost executor leaves no half file) with its table, its documents, its place in its range and a checksum;
it can be decoded without any other row, and from any checkpoint. Memory is bounded by a segment or one document.

Whole texts are encoded by parts at single spaces between two other characters. The tokenizer's own word split never
crosses such a space, so the ids are those of the whole text; the parts recur and are kept, up to ``KEPT``. A text that
holds an added token of the tokenizer, such as ``<|endoftext|>``, is given to the tokenizer whole, which reads it as that token.

A null text is empty: it has the end id only. Equal doc_ids are ordered by a hash of their texts, a null doc_id comes
first. An empty table gives an empty dataset. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicebox.llm import rans
from sluicebox.llm.common import map_batches, text_of

END = 2
BLOCK = 1 << 19
SEGMENT = 1 << 22
KEPT = 500_000

_BLOCKS = (
    "part int, part_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, frequencies binary, block binary"
)
_DOCUMENTS = "part int, part_start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"

#: Marks that may follow a word of letters; the tokenizer's split always parts them from it.
_ENDINGS = "!#$%&()*+,-./:;<=>?@[]^{|}~"
#: The end of the letters that all versions of Unicode agree on.
_PLAIN_END = "\u0250"

# The character that stands for each byte in a byte-level vocabulary: itself where it can be printed, else one of those from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _PRINTED]
_BYTE_CHARACTERS = {**{b: chr(b) for b in _PRINTED}, **{b: chr(256 + i) for i, b in enumerate(_REST)}}

#: A space that has white space beside it is no place to divide a text.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class _Parts(dict):
    """The ids of parts, filled in when a part is first asked for. ``space``: a space stands before each part.

    Two generations of ``KEPT`` parts are held, so that frequent parts are not forgotten with rare ones. A part with
    white space at an end has no ids of its own: None.
    """

    def __init__(self, tokenizer, kind: np.dtype, space: str, beginnings: _Parts | None = None):
        self.tokenizer, self.code, self.space = tokenizer, "H" if kind.itemsize == 2 else "I", space
        self.beginnings = self if beginnings is None else beginnings
        self.older: dict[str, bytes | None] = {}
        self.ask = tokenizer.model.tokenize
        self.mark = _BYTE_CHARACTERS[32] if space else ""

    def __missing__(self, part: str) -> bytes | None:
        ids = self.older.get(part) or self._ids(part)
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def _ids(self, part: str) -> bytes | None:
        if part.isalpha():
            # A run of letters is one word of the tokenizer's own split, so its model can be asked at once.
            if part.isascii():
                return array(self.code, [t.id for t in self.ask(self.mark + part)]).tobytes()
            if max(part) < _PLAIN_END:
                shown = "".join([_BYTE_CHARACTERS[b] for b in part.encode()])
                return array(self.code, [t.id for t in self.ask(self.mark + shown)]).tobytes()
            return self.whole(self.space + part)
        letters = part.rstrip(_ENDINGS)
        if letters.isalpha() and max(letters) < _PLAIN_END:
            return self[letters] + self.beginnings[part[len(letters) :]]
        if self.space and not part or part[:1].isspace() or part[-1:].isspace():
            return None
        head, line, tail = part.partition("\n")
        if line and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.whole("\n") + self.beginnings[tail]
        return self.whole(self.space + part)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """A byte-level tokenizer of the ``tokenizers`` library that keeps the ids of parts it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.first = _Parts(tokenizer, self.kind, "")
        self.later = _Parts(tokenizer, self.kind, " ", self.first)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as the little-endian numbers of ``kind``."""
        if any(token in text for token in self.added):
            return self.first.whole(text)
        first, *rest = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.later.__getitem__, rest))
        except TypeError:  # None: spaces beside other white space belong together
            first, *rest = _SAFE.split(text)
            later = [self.later[p] or self.later.whole(" " + p) for p in rest]
            return (self.first[first] or self.first.whole(first)) + b"".join(later)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _coded(pending: list[tuple], part: int, start: int) -> Iterator[dict]:
    """The blocks of a segment; ``pending``: doc_id and ids of its documents."""
    packed = rans.pack_table(np.concatenate([ids for _, ids in pending]))
    table = rans.Table(packed)
    at, total = 0, 0
    for i, (_, ids) in enumerate(pending):
        total += len(ids)
        if total >= BLOCK or i + 1 == len(pending):
            own = pending[at : i + 1]
            yield {
                "part": [part], "part_start": [start], "n_tokens": [total], "doc_ids": [[d for d, _ in own]],
                "doc_tokens": [[len(x) for _, x in own]], "frequencies": [packed],
                "block": [rans.encode(np.concatenate([x for _, x in own]), table)],
            }
            start, at, total = start + total, i + 1, 0


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the blocks of ``docs`` in ascending doc_id order below ``path``."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        coder = encoder(tokenizer)
        end = np.array([END], dtype=coder.kind).tobytes()
        pending: list[tuple] = []
        waiting = start = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.frombuffer(coder.encode(text.as_py()) + end, dtype=coder.kind)
                pending.append((doc_id.as_py(), ids))
                waiting += len(ids)
                if waiting >= SEGMENT:
                    yield from _coded(pending, part, start)
                    start, waiting = start + waiting, 0
                    pending.clear()
        if pending:
            yield from _coded(pending, part, start)

    texts = docs.select("doc_id", F.xxhash64(text_of("text")).alias("tie"), text_of("text").alias("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    map_batches(ordered.select("doc_id", "text"), run, _BLOCKS).write.parquet(path)


def _decoded(batches: Iterator[dict]) -> Iterator[dict]:
    last: tuple[bytes, rans.Table] | None = None
    for batch in batches:
        for row in range(len(batch["block"])):
            part, start, _, doc_ids, sizes, packed, block = (batch[c][row].as_py() for c in _COLUMNS)
            if last is None or last[0] != packed:
                last = (packed, rans.Table(packed))
            ids = rans.decode(block, last[1]).astype("<u4")
            ends = np.cumsum(sizes)
            yield {
                "part": [part] * len(sizes), "part_start": start + ends - sizes, "doc_id": doc_ids, "n_tokens": sizes,
                "ids_crc32": [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)],
            }


_COLUMNS = ["part", "part_start", "n_tokens", "doc_ids", "doc_tokens", "frequencies", "block"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded blocks alone."""
    blocks = spark.read.parquet(path)
    documents = map_batches(blocks.select(*_COLUMNS), _decoded, _DOCUMENTS)
    parts = blocks.groupBy(F.col("part").alias("of")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row per written range
    return documents.join(F.broadcast(offsets), F.col("part") == F.col("of")).select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for row in range(len(batch["block"])):
                doc_ids, sizes, packed, block = (batch[c][row].as_py() for c in _COLUMNS[3:])
                ids = rans.decode(block, rans.Table(packed)).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield {"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}

    return map_batches(spark.read.parquet(path).select(*_COLUMNS), run, "doc_id bigint, ids array<int>")
