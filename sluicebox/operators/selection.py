"""Pick an exact number of rows by keyed hash, without sorting or moving them.

The k rows with the smallest hashes are a uniform sample of size k. Their largest hash is a cutoff, and
``hash <= cutoff`` is a row-local filter. The cutoff is found from counts of hash prefixes: a fixed number of bins
per pass, whatever the size of the table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.functions.draws import keyed_hash

STEP_DIGITS = 4
BINS = 16**STEP_DIGITS  # counts that reach the driver in a pass, over all labels
HASH_DIGITS = 16
ABOVE_HEX = "~"  # sorts after every hex digit
NOTHING = ""  # sorts before every hash

Hashes = list[tuple[str, Column]]


def cell_hash(seed: int, stream: str, key: Column, place: int = 0) -> Column:
    """Sixteen hex digits for the ``place``-th cell of a row; two cells share one digest."""
    return F.substring(keyed_hash(seed, f"{stream}|{place // 2}", key), 1 + HASH_DIGITS * (place % 2), HASH_DIGITS)


@dataclass
class _Search:
    """Where the k-th smallest hash of one label is looked for: above ``low``, below ``high``, by ``digits`` digits.

    Hashes below ``low`` are only counted.
    """

    wanted: int
    digits: int = STEP_DIGITS
    low: str = NOTHING
    high: str = ABOVE_HEX

    def bin(self, h: Column) -> Column:
        """The bin of a hash; empty below the range."""
        inside = F.substring(h, 1, self.digits)
        return F.when(h < self.low, F.lit(NOTHING)).otherwise(inside) if self.low else inside

    @classmethod
    def around(cls, k: int, population: int, bins: int = BINS) -> _Search:
        """The range that almost surely holds the k-th smallest of ``population`` uniform hashes.

        A range of no more than ``bins`` hashes is read hash by hash, a longer one in at most ``bins`` bins.
        """
        margin = 8 * math.sqrt(k) + 8
        low, high = max(0.0, (k - margin) / population), min(1.0, (k + margin) / population)
        edge = HASH_DIGITS - STEP_DIGITS  # digits that a double still tells apart
        digits = 1
        while digits < edge and (high - low) * 16 ** (digits + 1) <= bins:
            digits += 1
        return cls(
            k,
            HASH_DIGITS if (high - low) * population <= bins else digits,
            format(int(low * 16**edge), f"0{edge}x") if low > 0 else NOTHING,
            format(int(high * 16**edge) + 1, f"0{edge}x") if high < 1 - 1e-9 else ABOVE_HEX,
        )


def smallest_cutoffs(
    df: DataFrame, hashes: Hashes, wanted: Mapping[str, int], rows: int | None = None
) -> dict[str, str]:
    """For each label, the cutoff c such that exactly ``wanted[label]`` hashes of that label are ``<= c``.

    ``hashes`` lists (label, hash column) pairs; columns that share a label are ranked together. All labels are
    served by the same passes. With the number of ``rows``, one pass is usually enough.
    """
    cutoffs = {label: NOTHING for label, k in wanted.items() if k <= 0}
    width = Counter(label for label, _ in hashes)
    bins_each = max(16, BINS // max(1, len(wanted)))
    step = max(1, int(math.log(bins_each, 16) + 1e-9))
    search = {
        label: _Search.around(k, rows * width[label], bins_each) if rows else _Search(k, step) for label, k in wanted.items() if k > 0
    }
    while search:
        open_ = [(label, h, search[label]) for label, h in hashes if label in search]
        bins = (
            _exploded(df, [(label, h < s.high, s.bin(h)) for label, h, s in open_], "bin")
            .groupBy("label", "bin")
            .count()
            .toPandas()  # BINS rows, or 16 per label
            .sort_values(["label", "bin"])
        )
        for label, s in list(search.items()):
            crossing = _crossing(bins[bins["label"] == label], s.wanted)
            if crossing is None or crossing[0] == NOTHING:
                if s.low == NOTHING and s.high == ABOVE_HEX:
                    raise ValueError(f"cannot pick {wanted[label]} out of fewer candidates")
                search[label] = _Search(wanted[label], step)  # the range missed the cutoff: look everywhere
                continue
            bin_, needed, size = crossing
            if needed == size:
                cutoffs[label] = bin_ + ABOVE_HEX
                del search[label]
            elif s.digits >= HASH_DIGITS:
                raise ValueError("the key columns do not identify a row: equal keys at the sampling cutoff")
            else:
                digits = min(s.digits + step, HASH_DIGITS)
                search[label] = _Search(s.wanted, digits, bin_, bin_ + ABOVE_HEX)
    return cutoffs


def _exploded(df: DataFrame, cells: list[tuple[str, Column, Column]], name: str) -> DataFrame:
    """(label, value) for each cell of each row whose condition holds.

    The cells are built in a projection of their own, where a digest that two of them share is computed once. The
    outer form of explode keeps the optimizer from testing the cells a second time before the projection.
    """
    kept = [F.when(hit, F.struct(F.lit(label).alias("label"), value.alias(name))) for label, hit, value in cells]
    each = df.select(F.array(*kept).alias("cells")).select(F.explode_outer("cells").alias("cell"))
    return each.where("cell IS NOT NULL").select("cell.label", f"cell.{name}")


def _crossing(bins: pd.DataFrame, k: int) -> tuple[str, int, int] | None:
    """The bin that holds the k-th smallest hash, how many of its rows are needed and how many it has."""
    running = bins["count"].cumsum()
    if len(running) == 0 or running.iloc[-1] < k:
        return None
    at = int((running >= k).to_numpy().argmax())
    size = int(bins["count"].iloc[at])
    return bins["bin"].iloc[at], k - int(running.iloc[at]) + size, size


def smallest_hashes(
    df: DataFrame, hashes: Hashes, cutoffs: Mapping[str, str], wanted: Mapping[str, int]
) -> dict[str, list[str]]:
    """The ``wanted[label]`` smallest hashes of each label, in order; meant for a few hundred per label.

    The rank bound is applied inside each task before the shuffle.
    """
    asked = {label: k for label, k in wanted.items() if k > 0}
    found: dict[str, list[str]] = {label: [] for label in wanted}
    if not asked:
        return found
    below = [(label, h <= cutoffs[label], h) for label, h in hashes if label in asked]
    ranked = (
        _exploded(df, below, "hash")
        .withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("hash")))
        .where(F.col("rank") <= max(asked.values()))
    )
    for r in sorted(ranked.collect()):
        if r["rank"] <= asked[r["label"]]:
            found[r["label"]].append(r["hash"])
    return found
