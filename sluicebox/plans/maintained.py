"""The security posture view kept up to date from changes, without reading the simulations again.

The state has one row per attack type: counts and sums, to which changes add with a sign, and the latest start. A latest start
that was taken away cannot be found from sums; only the groups that lost theirs are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.scalars import percent
from sluicebox.scratch import written

GROUP = "attack_type"
_WIDE = "decimal(28,12)"


def _measures() -> dict[str, Column]:
    """The summed columns of the view, each null-aware."""
    return {
        "score": F.col("security_score").cast(_WIDE),
        "detected": percent("attempts_detected", "attempts_total").cast(_WIDE),
        "mttd": F.col("mttd_avg_ms").cast(_WIDE),
        "successful": F.col("attempts_successful").cast("bigint"),
    }


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    """One row per attack type with what ``rows`` add or take; counted inside each task first."""
    sums = []
    for name, c in _measures().items():
        sums += [(F.sum(c) * sign).alias(f"{name}_sum"), (F.count(c) * sign).alias(f"{name}_count")]
    last = F.max("start_time")
    none = F.lit(None).cast(rows.schema["start_time"].dataType)
    return rows.where(F.col("attempts_total") > 0).groupBy(GROUP).agg(
        (F.count(F.lit(1)) * sign).alias("simulations"),
        *sums,
        (last if sign > 0 else F.max(none)).alias("added_last"),
        (last if sign < 0 else F.max(none)).alias("taken_last"),
    ).withColumn("known_last", none)


def _added_up(parts: DataFrame) -> DataFrame:
    summed = ["simulations", *[f"{m}_{kind}" for m in _measures() for kind in ("sum", "count")]]
    lasts = ["known_last", "added_last", "taken_last"]
    return parts.groupBy(GROUP).agg(*[F.sum(c).alias(c) for c in summed], *[F.max(c).alias(c) for c in lasts])


def posture_state(simulations: DataFrame) -> DataFrame:
    """The state of a whole table, from which changes go on."""
    state = _signed(simulations, 1)
    return state.withColumn("known_last", F.col("added_last")).drop("added_last", "taken_last")


def changed_posture(state: DataFrame, removed: DataFrame, added: DataFrame, current: DataFrame) -> DataFrame:
    """The state after rows were ``removed`` and ``added``; an updated row is among both, as it was and as it is.

    ``current`` is the table after the change. It is read only for attack types whose latest simulation was removed, and only
    in two columns. A group without simulations left is gone, as it is from the view.
    """
    none = F.lit(None).cast(state.schema["known_last"].dataType)
    parts = state.withColumns({"added_last": none, "taken_last": none})
    merged = written(_added_up(parts.unionByName(_signed(removed, -1)).unionByName(_signed(added, 1))).where("simulations > 0"), "posture")
    best = F.greatest("known_last", "added_last")
    lost = (F.col("taken_last") >= F.col("known_last")) & F.coalesce(F.col("added_last") < F.col("known_last"), F.lit(True))
    lost = F.coalesce(lost, F.lit(False))
    keep = [c for c in merged.columns if c not in ("known_last", "added_last", "taken_last")]
    settled = merged.where(~lost).select(*keep, best.alias("known_last"))
    open_ = merged.where(lost)
    if open_.isEmpty():
        return settled
    groups = open_.select(F.col(GROUP).alias("_group"))
    rows = current.where(F.col("attempts_total") > 0).select(GROUP, "start_time")
    again = rows.join(groups, F.col(GROUP).eqNullSafe(F.col("_group")), "left_semi").groupBy(F.col(GROUP).alias("_group")).agg(
        F.max("start_time").alias("known_last")
    )
    found = open_.select(*keep).join(again, F.col(GROUP).eqNullSafe(F.col("_group")), "left").select(*keep, "known_last")
    return settled.unionByName(found)


def posture_of(state: DataFrame) -> DataFrame:
    """The view's rows, as ``security_posture`` gives them."""

    def mean(name: str) -> Column:
        count = F.nullif(F.col(f"{name}_count"), F.lit(0)).cast("decimal(20,0)")
        return F.round((F.col(f"{name}_sum").cast(_WIDE) / count).cast("decimal(32,16)"), 2)

    return state.select(
        GROUP,
        F.col("simulations").alias("total_simulations"),
        mean("score").alias("avg_security_score"),
        mean("detected").alias("avg_detection_rate"),
        mean("mttd").alias("avg_mttd_ms"),
        F.when(F.col("successful_count") > 0, F.col("successful_sum")).alias("total_successful_attacks"),
        F.col("known_last").alias("last_simulation_date"),
    )
