"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemalign.llm.lookups import looked_up
from schemalign.operators.settle import settle


def _downhill(a: F.Column, b: F.Column) -> F.Column:
    return F.struct(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))


def _lowest(links: DataFrame, own: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(own, lowest): the smallest of each node and its neighbours; (own, rows): the number of its links."""
    grouped = settle(links.groupBy(own).agg(F.min(other).alias("least"), F.count(F.lit(1)).alias("rows")))
    return grouped.select(own, F.least(own, "least").alias("lowest")), grouped.select(own, "rows")


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node long, component long), component being the smallest node reachable.

    Each round sends a node's higher neighbours, then its lower ones, to the smallest neighbour; the links then shrink to
    stars around the smallest node of each component in a number of rounds that grows with the logarithm of the longest
    chain. Every round is written to the shared folder, joins on nodes with very many links are split. Nulls and links
    of a node with itself are left out; no links give no rows.
    """
    start = links.filter("a <> b").select(_downhill(F.col("a"), F.col("b")).alias("l"))
    stars = settle(start.select("l.*").distinct())
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if tuple(state) == seen or not state[0]:
            return (
                stars.select(F.col("high").alias("node"), F.col("low").alias("component"))
                .unionByName(stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
            )
        seen = tuple(state)
        both = stars.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            stars.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        lowest, rows = _lowest(both, "u", "v")
        large = (
            looked_up(both, lowest, ["u"], rows)
            .filter("v > u")
            .select(F.col("v").alias("high"), F.col("lowest").alias("low"))
            .distinct()
        )
        large = settle(large)
        lowest, rows = _lowest(large, "high", "low")
        small = looked_up(large, lowest, ["high"], rows).select(
            F.explode(F.array(F.struct("high", F.col("lowest").alias("low")), F.struct(F.col("low").alias("high"), F.col("lowest").alias("low")))).alias("l")
        )
        stars = settle(small.select("l.*").filter("high <> low").distinct())
