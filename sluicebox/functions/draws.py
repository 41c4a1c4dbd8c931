"""Keyed random draws: every value depends on (seed, stream, key) only, never on the partition layout."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 48


def new_seed() -> int:
    """A seed for callers that do not ask for reproducible output."""
    return secrets.randbits(31)


def key_text(keys: Sequence[str | Column]) -> Column:
    """One text per row from its key columns, different for different keys.

    A single key is its own text. Of several, a backslash stands before each separator and backslash; a null part is
    ``\\0``, which no text can be.
    """
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    if len(texts) == 1:
        return F.coalesce(texts[0], F.lit("\\0"))
    return F.concat_ws("|", *[F.coalesce(F.regexp_replace(t, r"([|\\])", r"\\$1"), F.lit("\\0")) for t in texts])


def keyed_hash(seed: int, stream: str, key: Column) -> Column:
    """32 hex digits, uniform over keys."""
    return F.md5(F.concat(F.lit(f"{seed}|{stream}|"), key.cast("string")))


def number(h: Column, start: int, digits: int) -> Column:
    """The integer that ``digits`` hex digits of a hash spell, 15 of them at most."""
    return F.conv(F.substring(h, start, digits), 16, 10).cast("bigint")


def draw(seed: int, stream: str, key: Column) -> Column:
    """A uniform integer below 2**48."""
    return number(keyed_hash(seed, stream, key), 1, DRAW_BITS // 4)


def unit(d: Column) -> Column:
    """A draw as a double in [0, 1)."""
    return d.cast("double") / F.lit(float(2**DRAW_BITS))
