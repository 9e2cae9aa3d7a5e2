"""Equi-joins with relations of one row per key, planned by what is counted first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemalign.operators.settle import settle
from schemalign.operators.skew import ROWS_PER_TASK, salted_lookup

# Ids sent to every task, at most: some 16 MB.
BROADCAST_IDS = 1_000_000


def looked_up(left: DataFrame, right: DataFrame, keys: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join of left with right, which holds each key once.

    counts are (keys..., rows) of left, counted here unless given, best settled. Only where a key has more rows than one
    task should read are keys split; otherwise the plan is the plain join.
    """
    keys = list(keys)
    if counts is None:
        counts = settle(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
    if counts.filter(F.col("rows") > ROWS_PER_TASK).isEmpty():
        return left.join(right, keys)
    return salted_lookup(left, right, keys, "inner", counts=counts)


def named_by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """looked_up where the settled right side has few columns of fixed size: it is sent while its rows are few."""
    if right.count() <= BROADCAST_IDS:
        return left.join(F.broadcast(right), list(keys))
    return looked_up(left, right, keys)


def without(rows: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """rows whose key is none of the settled ids; wide rows stay where they are while the ids are few."""
    return rows.join(_sent(ids), key, "left_anti")


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(_sent(ids), key, "left_semi")


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
