"""Keeping the dictionary: search, statistics, and set-based insert, upsert, delete and snapshot diff.

Every job returns a new version of the relation; write it to a new place, since a table being read is not replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.operators import skew
from schemalign.operators.settle import settle

KEYS = ("src", "target")


def filter_targets(dictionary: DataFrame, targets: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the chosen targets; an empty list chooses all. A large choice comes as a DataFrame."""
    if isinstance(targets, DataFrame):
        chosen = targets.select("target").distinct()
        return skew.looked_up(dictionary, chosen, ["target"], "left_semi").select(*dictionary.columns)
    return dictionary.filter(F.col("target").isin(list(targets))) if targets else dictionary


def source_matches(term: str) -> Column:
    """Case-insensitive search of a regular expression in the source name; no match for a missing name."""
    return F.coalesce(F.col("src").rlike(f"(?iu){term}"), F.lit(False))


def search_src(dictionary: DataFrame, term: str) -> DataFrame:
    return dictionary.filter(source_matches(term)) if term else dictionary


def deletable_sources(dictionary: DataFrame) -> DataFrame:
    """Source names with a mapping to something other than themselves, a missing target included, sorted."""
    other = F.col("src").isNotNull() & ~F.col("src").eqNullSafe(F.col("target"))
    return dictionary.filter(other).select("src").distinct().orderBy("src")


def distinct_targets(dictionary: DataFrame) -> DataFrame:
    """The target schema: every target once, sorted."""
    return dictionary.select("target").filter(F.col("target").isNotNull()).distinct().orderBy("target")


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    """One row: mappings, distinct targets, distinct sources; a missing value counts as one of its own.

    Distinct pairs are reduced first, so neither count runs over raw rows.
    """

    def distinct(name: str) -> Column:
        return F.countDistinct(name) + F.max(F.col(name).isNull().cast("int"))

    pairs = dictionary.groupBy("src", "target").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_mappings"),
        F.coalesce(distinct("target"), F.lit(0)).alias("unique_targets"),
        F.coalesce(distinct("src"), F.lit(0)).alias("unique_sources"),
    )


def _checked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows as they are; running into a NULL key fails the job.

    The check is part of the key itself, so no filter on the key can drop the row unseen.
    """

    def known(key: str) -> Column:
        stop = F.raise_error(F.lit(f"key must not be NULL: {key}")).cast(df.schema[key].dataType)
        return F.coalesce(F.col(key), stop)

    return df.withColumns({key: known(key) for key in keys})


def insert_if_absent(base: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """base and the new rows whose keys it lacks; of new rows with equal keys the least is taken, by its columns in order, nulls last."""
    rest = [c for c in new.columns if c not in keys]
    if rest:
        nulls_last = [x for i, c in enumerate(rest) for x in (F.col(c).isNull().alias(f"_{i}"), F.col(c))]
        least = F.col("_least")
        one_each = new.groupBy(*keys).agg(F.min(F.struct(*nulls_last)).alias("_least")).select(*keys, *[least[c].alias(c) for c in rest])
    else:
        one_each = new.select(*keys).distinct()
    absent = one_each.join(base.select(*keys).distinct(), list(keys), "left_anti")
    return base.unionByName(absent.select(*new.columns), allowMissingColumns=True)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str]) -> DataFrame:
    """Matched rows get the listed columns of the update, unmatched updates become rows.

    Two updates for one key fail the job, as does a NULL key. The updates are settled. While they are few, nothing of the
    base is shuffled; otherwise it is counted by key once, which tells its heavy keys and which updates are new.
    """
    twice = F.raise_error(F.concat(F.lit("several updates for "), F.concat_ws(", ", *keys))).cast("boolean")
    single = settle(
        _checked(updates, keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(f"_new_{c}") for c in set_cols])
        .filter(F.when(F.col("_n") > 1, twice).otherwise(F.lit(True)))
        .drop("_n")
        .withColumn("_matched", F.lit(True))
    )
    if skew.fits(single):
        matched = base.join(F.broadcast(single), list(keys), "left")
        present = base.select(*keys).join(F.broadcast(single.select(*keys)), list(keys), "left_semi").distinct()
    else:
        counts = settle(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
        matched = skew.by_counts(base, single, keys, "left", counts)
        present = counts.select(*keys)
    kept = matched.select(
        *[
            F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
            for c in base.columns
        ]
    )
    inserted = single.join(present, list(keys), "left_anti").select(*keys, *[F.col(f"_new_{c}").alias(c) for c in set_cols])
    return kept.unionByName(inserted, allowMissingColumns=True)


def delete_keys(
    base: DataFrame, listed: DataFrame, keys: Sequence[str] = KEYS, protect_identity: bool = False
) -> DataFrame:
    """base without the rows whose key is listed; identity rows (src = target) stay where protected."""
    doomed = _checked(listed.select(*keys), keys).distinct().withColumn("_doomed", F.lit(True))
    marked = skew.looked_up(base, doomed, keys, "left")
    gone = F.coalesce(F.col("_doomed"), F.lit(False))
    if protect_identity:
        gone = gone & ~F.col("src").eqNullSafe(F.col("target"))
    return marked.filter(~gone).select(*base.columns)


def deleted_count(base: DataFrame, listed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How many rows delete_keys removes: counted per key first, so nothing but counts is joined."""
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hit = counts.join(listed.select(*keys).distinct(), list(keys), "left_semi")
    return hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted"))


def except_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*keys).subtract(right.select(*keys))


def common_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def snapshot_diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, value: str = "description"
) -> DataFrame:
    """(keys..., old_value, new_value, change): delete, insert, update or same for every key of either side.

    A missing value counts as ''. A key occurring several times is one key with its least value.
    """

    def one_each(df: DataFrame, name: str) -> DataFrame:
        known = df.select(*keys, F.coalesce(F.col(value), F.lit("")).alias(name))
        return _checked(known, keys).groupBy(*keys).agg(F.min(name).alias(name))

    both = one_each(old, "old_value").join(one_each(new, "new_value"), list(keys), "full_outer")
    change = (
        F.when(F.col("new_value").isNull(), "delete")
        .when(F.col("old_value").isNull(), "insert")
        .when(F.col("old_value") != F.col("new_value"), "update")
        .otherwise("same")
    )
    return both.withColumn("change", change)


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("keys"))


def apply_diff(
    base: DataFrame, diff: DataFrame, keys: Sequence[str] = KEYS, value: str = "description"
) -> DataFrame:
    """base after the diff: all copies of deleted keys gone, updated values set, inserted keys added once."""
    changed = diff.filter(F.col("change").isin("delete", "update")).select(*keys, "new_value", "change")
    marked = skew.looked_up(base, changed, keys, "left").filter(~F.col("change").eqNullSafe(F.lit("delete")))
    kept = marked.withColumn(value, F.when(F.col("change") == "update", F.col("new_value")).otherwise(F.col(value)))
    inserted = diff.filter(F.col("change") == "insert").select(*keys, F.col("new_value").alias(value))
    return kept.select(*base.columns).unionByName(inserted, allowMissingColumns=True)


def merge_filtered_edit(base: DataFrame, shown: Column, edited: DataFrame) -> DataFrame:
    """Replace exactly the rows that were shown by the edited ones."""
    return base.filter(~F.coalesce(shown, F.lit(False))).unionByName(edited)
