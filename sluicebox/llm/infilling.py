"""Fill-in-the-middle texts: two seeded cuts, and the pieces put in a new order behind marks.

A text is a list of units (code points, or words with the white space after them). They are indexed by a skip list: in
lane 0 each link spans one unit, in every higher lane a link spans ``EXPRESS`` links of the lane below, and each
link carries its width in units and in code points. A cut at a rank of units descends from the highest lane: along a
lane for as long as its link does not pass the rank, adding up both widths, then one lane down. So both cuts end at the
exact unit and know their place in code points after a few steps a lane, and a list can be changed at one unit by
changing one link a lane.

The first four groups of eight digits of the SHA-256 of ``<seed>:<doc_id>`` decide: the smaller of the first two
(modulo units + 1) ends the prefix, the larger the middle; the third leaves ``100 - RATE`` percent of the texts plain,
the fourth gives ``SPM_RATE`` percent of the others the order suffix, prefix, middle instead of prefix, suffix, middle. An empty
text, and one that holds a mark, stays plain, so an output is read back without doubt.

Each row is read by itself: no shuffle, and memory for one batch of texts and the index of one. A null text is empty. A null
doc_id counts as an empty one in the hash and is passed through. Repeated rows give repeated results, an empty table an
empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Percent of the texts that are changed.
RATE = 90
#: Percent of the changed texts that begin with the suffix.
SPM_RATE = 20
#: Links of a lane that one link of the next lane spans.
EXPRESS = 32

UNITS = ("characters", "words")
_WORD_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")


class SkipList:
    """A list of units by rank; ``widths`` holds the code points of each unit."""

    def __init__(self, widths: np.ndarray):
        units, points = np.ones(len(widths), dtype=np.int32), np.array(widths, dtype=np.int32)
        self.lanes = [(units, points)]
        while len(units) > EXPRESS:
            firsts = np.arange(0, len(units), EXPRESS)
            units, points = np.add.reduceat(units, firsts), np.add.reduceat(points, firsts)
            self.lanes.append((units, points))

    def __len__(self) -> int:
        return int(self.lanes[-1][0].sum())

    def code_points(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= len(self):
            raise IndexError(rank)
        units = points = link = 0
        for lane_units, lane_points in reversed(self.lanes):
            link *= EXPRESS
            while link < len(lane_units) and units + lane_units[link] <= rank:
                units += int(lane_units[link])
                points += int(lane_points[link])
                link += 1
        return points

    def resize(self, unit: int, width: int) -> None:
        """Give a unit another width: one link of each lane changes."""
        change = width - int(self.lanes[0][1][unit])
        for _, points in self.lanes:
            points[unit] += change
            unit //= EXPRESS


def unit_widths(text: str, units: str) -> np.ndarray:
    """Code points of each unit of a text."""
    if units == "characters":
        return np.ones(len(text), dtype=np.int32)
    return np.array([m.end() - m.start() for m in _WORD_UNIT.finditer(text)], dtype=np.int64)


def seeded(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide about a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def infilled(doc_id: int | None, text: str, seed: int, units: str) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    widths = unit_widths(text, units)
    n = len(widths)
    first, second, changed, order = seeded(doc_id, seed)
    if not text or changed % 100 >= RATE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    index = SkipList(widths)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    a, b = index.code_points(a), index.code_points(b)
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if order % 100 < SPM_RATE:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def restored(output: str, form: str) -> str:
    """The text that an output was made from, read from its marks."""
    if form == "plain":
        return output
    body, _, middle = output.partition(MIDDLE)
    if form == "spm":
        suffix, _, prefix = body.removeprefix(SUFFIX).partition(PREFIX)
    else:
        prefix, _, suffix = body.removeprefix(PREFIX).partition(SUFFIX)
    return prefix + middle + suffix


_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transform(docs: DataFrame, seed: int = SEED, units: str = "characters") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output."""
    if units not in UNITS:
        raise ValueError(f"unknown units {units!r}: use one of {', '.join(UNITS)}")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            rows = [infilled(i, t, seed, units) for i, t in zip(ids, texts, strict=True)]
            yield dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), zip(*rows, strict=True), strict=True)) | {"doc_id": ids}

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), text_of("text").alias("text")), run, _SCHEMA)


def read_back(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform`` with digests of the output and of the text rebuilt from output and form, in their place."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            outputs = batch["output"].to_pylist()
            texts = map(restored, outputs, batch["form"].to_pylist())
            yield batch | {"output_sha256": list(map(_sha256, outputs)), "restored_sha256": list(map(_sha256, texts))}

    return map_batches(transformed, run, _SCHEMA.removesuffix("output string") + "output_sha256 string, restored_sha256 string")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
