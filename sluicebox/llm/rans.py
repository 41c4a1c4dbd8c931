"""Range asymmetric numeral system over token ids, with numpy lanes.

A frequency table scales the counts of ids to a total of 2^20. A block of n tokens is coded in ``LANES`` interleaved
64-bit states: token i belongs to lane i mod LANES. Each lane gives off 32-bit words, which stand in the order in which
the decoder takes them. Checkpoints keep the states and the word position every ``EVERY`` steps, so that parts of a
block are decoded by themselves. Layout, little endian:

magic, n tokens, lanes, steps between checkpoints, checkpoints, words (six u32), then the checkpoints' word positions
(u32) and states (u64 each lane), the words (u32), and the CRC-32 of all before it (u32).
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 20
LANES = 1024
EVERY = 128
MAGIC = 0x314E4152
_LOW = np.uint64(1 << 32)
_HALF = np.uint64(32)
_MASK = np.uint64((1 << 32) - 1)
_SLOTS = np.uint64((1 << BITS) - 1)


def pack_table(ids: np.ndarray) -> bytes:
    """The frequency table of ``ids``: symbols and frequencies that sum to 2^20, compressed."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts).astype(np.uint32)
    own = counts[symbols]
    if len(symbols) > 1 << BITS:
        raise ValueError("more different ids than slots")
    scaled = 1 + own * ((1 << BITS) - len(symbols)) // max(1, own.sum())
    if len(scaled):
        scaled[own.argmax()] += (1 << BITS) - scaled.sum()
    steps = np.diff(symbols, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.tobytes() + scaled.astype("<u4").tobytes(), 6)


class Table:
    def __init__(self, packed: bytes):
        both = np.frombuffer(zlib.decompress(packed), dtype="<u4")
        self.symbols = np.cumsum(both[: len(both) // 2], dtype=np.uint32)
        frequencies = both[len(both) // 2 :].astype(np.uint64)
        self.starts = np.cumsum(frequencies, dtype=np.uint64) - frequencies
        self.frequencies = frequencies
        self.place = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, dtype=np.uint32)
        self.place[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)
        self._slot: np.ndarray | None = None

    @property
    def slot(self) -> np.ndarray:
        if self._slot is None:
            self._slot = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.frequencies.astype(np.int64))
        return self._slot


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    place = table.place[ids]
    states = np.full(LANES, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    frequencies, starts, limit_shift = table.frequencies, table.starts, np.uint64(64 - BITS)
    for step in range(steps - 1, -1, -1):
        now = place[step * LANES : (step + 1) * LANES]
        x = states[: len(now)]
        f = frequencies[now]
        # x >= f * 2^(64 - BITS), written so that f = 2^BITS cannot overflow
        full = (x >> limit_shift) >= f
        words.append((x[full] & _MASK).astype("<u4"))
        x = np.where(full, x >> _HALF, x)
        quotient, rest = np.divmod(x, f)
        states[: len(now)] = (quotient << np.uint64(BITS)) + rest + starts[now]
        if step % EVERY == 0:
            marks.append(states.copy())
    words.reverse()
    marks.reverse()
    used = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    head = np.array([MAGIC, n, LANES, EVERY, len(marks), used[-1]], dtype="<u4")
    body = b"".join([
        head.tobytes(), used[:-1:EVERY].astype("<u4").tobytes() if steps else b"", *[m.astype("<u8").tobytes() for m in marks],
        *[w.tobytes() for w in words],
    ])
    return body + np.uint32(zlib.crc32(body)).astype("<u4").tobytes()


def checkpoints(block: bytes) -> int:
    return int(np.frombuffer(block, dtype="<u4", count=6)[4])


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids between two checkpoints (by default all), after the checksum is verified."""
    if zlib.crc32(memoryview(block)[:-4]) != int.from_bytes(block[-4:], "little"):
        raise ValueError("checksum of a block")
    magic, n, lanes, every, marks, n_words = (int(v) for v in np.frombuffer(block, dtype="<u4", count=6))
    if magic != MAGIC:
        raise ValueError("not a block")
    if first >= marks:
        return np.zeros(0, dtype=np.uint32)
    at = 24
    positions = np.frombuffer(block, dtype="<u4", count=marks, offset=at)
    at += 4 * marks + 8 * lanes * first
    states = np.frombuffer(block, dtype="<u8", count=lanes, offset=at).astype(np.uint64)
    at += 8 * lanes * (marks - first)
    words = np.frombuffer(block, dtype="<u4", count=n_words, offset=at).astype(np.uint64)
    begin, end = first * every, min(-(-n // lanes), (marks if last is None else last) * every)
    out = np.empty(min(n, end * lanes) - begin * lanes, dtype=np.uint32)
    position = int(positions[first])
    slot, frequencies, starts = table.slot, table.frequencies, table.starts
    shift = np.uint64(BITS)
    for step in range(begin, end):
        active = min(lanes, n - step * lanes)
        x = states[:active]
        low = x & _SLOTS
        now = slot[low]
        x = frequencies[now] * (x >> shift) + low - starts[now]
        short = x < _LOW
        taken = int(short.sum())
        if taken:
            x[short] = (x[short] << _HALF) | words[position : position + taken]
            position += taken
        states[:active] = x
        out[(step - begin) * lanes : (step - begin) * lanes + active] = now
    return table.symbols[out] if len(out) else out
