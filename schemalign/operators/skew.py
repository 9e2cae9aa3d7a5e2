"""Equi-joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.operators.settle import settle

ROWS_PER_TASK = 200_000

# A key is split if it holds more than this share of all rows (and more than rows_per_task), so there are at most as many
# heavy keys as the share's inverse, and a key that is not split holds at most that share.
LEAST_SHARE = 1e-4

_NO_HASH = ("map<", "variant", "interval")


def heaviest(counts: DataFrame, keys: Sequence[str], rows_per_task: int, splits: str) -> DataFrame:
    """(keys..., rows) -> (_key_hash long, splits int) of the keys to be split; the hash is 8 bytes, so a row has 12 bytes.

    Keys that share a hash are split alike, which does no harm. At most 1 / LEAST_SHARE rows.
    """
    share = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)) * LEAST_SHARE).scalar()
    return (
        counts.filter((F.col("rows") > rows_per_task) & (F.col("rows") > share))
        .select(_hash(keys).alias("_key_hash"), F.ceil(F.col("rows") / rows_per_task).cast("int").alias(splits))
        .groupBy("_key_hash")
        .agg(F.max(splits).alias(splits))
    )


def heavy_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int, splits: str) -> DataFrame:
    return heaviest(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), keys, rows_per_task, splits)


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _parts(splits: str) -> Column:
    return F.coalesce(F.col(splits), F.lit(1))


def _salt(df: DataFrame, keys: Sequence[str], parts: Column) -> Column:
    """A part for each row: by what the row holds besides its keys, and by the partition it stands in.

    Both are the same when a task is run again. The content spreads rows that a shuffle has put together by their key,
    the partition spreads rows that hold nothing but the key.
    """
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if c not in keys and not any(k in kind for k in _NO_HASH)]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *rest), parts).cast("int")


def _with_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    return df.withColumn("_key_hash", _hash(keys)).join(F.broadcast(heavy), "_key_hash", "left").drop("_key_hash")


def _copied(df: DataFrame, part: str, parts: Column) -> DataFrame:
    return df.withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join many left rows to a right side holding each key at most once (inner, left, left_semi or left_anti).

    A heavy key's left rows spread over several tasks and its right row is copied to each of them. counts are
    (keys..., rows) of the left side where they are known already.
    """
    keys = list(keys)
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    heavy = heaviest(counts, keys, rows_per_task, "_splits")
    spread = _with_heavy(left, keys, heavy).withColumn("_salt", _salt(left, keys, _parts("_splits")))
    copied = _copied(_with_heavy(right, keys, heavy), "_salt", _parts("_splits"))
    return spread.drop("_splits").join(copied.drop("_splits"), [*keys, "_salt"], how).drop("_salt")


def salted_grid_join(left: DataFrame, right: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """Inner join where a key may be heavy on both sides: its rows form a grid of (left part, right part) cells."""
    heavy_left = heavy_keys(left, [key], rows_per_task, "_lsplits")
    heavy_right = heavy_keys(right, [key], rows_per_task, "_rsplits")

    def located(df: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        both = _with_heavy(_with_heavy(df, [key], heavy_left), [key], heavy_right)
        placed = both.withColumn(own_part, _salt(df, [key], _parts(own)))
        return _copied(placed, other_part, _parts(other)).drop("_lsplits", "_rsplits")

    lhs = located(left, "_lsplits", "_rsplits", "_lpart", "_rpart")
    rhs = located(right, "_rsplits", "_lsplits", "_rpart", "_lpart")
    return lhs.join(rhs, [key, "_lpart", "_rpart"]).drop("_lpart", "_rpart")


# Right sides of lookups are sent to every task up to about so many bytes.
BROADCAST_BYTES = 32_000_000


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether a settled relation is small enough to be sent: counted in bytes, texts by their length."""
    most = BROADCAST_BYTES if most is None else most
    sizes = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    row = sum(sizes, F.lit(16))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"] <= most


def looked_up(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join many left rows to a right side holding each key at most once (inner, left, left_semi or left_anti).

    The right side is settled and measured: a small one is sent to every task, so that the left rows stay where they are
    and are not counted. Beyond that the left keys are counted once (counts, (keys..., rows), where they are known), and
    only if one has more rows than a task should read are keys split.
    """
    keys = list(keys)
    right = settle(right)
    if fits(right):
        return left.join(F.broadcast(right), keys, how)
    counts = settle(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")) if counts is None else counts)
    return by_counts(left, right, keys, how, counts)


def by_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, counts: DataFrame) -> DataFrame:
    """The plain join, unless the settled counts tell of a key with more left rows than a task should read."""
    keys = list(keys)
    if counts.filter(F.col("rows") > ROWS_PER_TASK).isEmpty():
        return left.join(right, keys, how)
    return salted_lookup(left, right, keys, how, counts=counts)
