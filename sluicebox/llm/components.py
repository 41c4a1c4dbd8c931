"""Connected components of a table of links, by alternating large and small stars.

Each round hangs all larger neighbours of a node on its smallest neighbour, then all smaller ones; the rounds end
when the links no longer change, after a number of rounds that grows with the logarithm of the longest chain. Only joins
and partial minima: a hub with a third of the links is split by adaptive execution. Every round is written to the
shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.scratch import written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v bigint): the component is its smallest node."""
    edges = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m")).select("at", F.least("at", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("at")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        hung = large.join(lower, F.col("u") == F.col("at")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(hung.unionByName(lower.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
