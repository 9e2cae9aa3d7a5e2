"""The dictionary as the matcher needs it: one row per distinct normalised source name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemalign.functions import text
from schemalign.operators import skew


def last_target(dictionary: DataFrame) -> DataFrame:
    """(src, target) -> (src, target, copies): one target per source name, the greatest of several."""
    return dictionary.groupBy("src").agg(F.max("target").alias("target"), F.count(F.lit(1)).alias("copies"))


def lookup_target(names: DataFrame, dictionary: DataFrame, name_col: str = "src") -> DataFrame:
    """Target of each name, UNMAPPED where the dictionary has none."""
    known = last_target(dictionary).select(F.col("src").alias(name_col), F.col("target").alias("target_field"))
    return skew.looked_up(names, known, [name_col], "left").select(*names.columns, "target_field").withColumn(
        "target_field", F.coalesce("target_field", F.lit(text.UNMAPPED))
    )


def lexicon(dictionary: DataFrame, top_n: int) -> DataFrame:
    """(key, copies, rows): per normalised name how often it occurs, and its first top_n source names.

    Names with the same normal form score alike, so no more than their first top_n can appear in one answer;
    copies still counts all of them for the document frequencies.
    """
    return keyed_rows(last_target(dictionary), top_n)


def keyed_rows(entries: DataFrame, top_n: int) -> DataFrame:
    """The same of (src, target, copies), a source name once."""
    keyed = entries.withColumn("key", text.normalize_name(F.col("src")))
    by_src = Window.partitionBy("key").orderBy(F.col("src").asc_nulls_last())
    first = (
        keyed.withColumn("nth", F.row_number().over(by_src))
        .filter(F.col("nth") <= top_n)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "src", "target", "copies"))).alias("rows"))
    )
    totals = keyed.groupBy("key").agg(F.sum("copies").alias("copies"))
    return totals.join(first, "key")


@dataclass(frozen=True)
class LexiconFacts:
    """What plan choices depend on: a few numbers and names, never the data."""

    keys: int
    characters: int
    has_terms: bool
    has_empty: bool
    first_keys: list[str]

    def fits_broadcast(self, max_keys: int, max_characters: int = 100_000) -> bool:
        return self.keys <= max_keys and self.characters <= max_characters


def inspect(sources: DataFrame, first_names: int) -> LexiconFacts:
    """The facts, with the keys of the first so many source names (0 where they are not needed)."""
    key = F.col("key")
    row = sources.agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(F.length(key)), F.lit(0)).alias("characters"),
        F.coalesce(F.max(key.rlike(r"[\p{L}\p{N}_]{2}")), F.lit(False)).alias("has_terms"),
        F.coalesce(F.max(key == ""), F.lit(False)).alias("has_empty"),
    ).first()
    first_keys: list[str] = []
    if first_names:
        in_order = sources.orderBy(F.get("rows", F.lit(0))["src"].asc_nulls_last()).limit(first_names)
        first_keys = [r["key"] for r in in_order.select("key").collect()]
    return LexiconFacts(row["keys"], row["characters"], row["has_terms"], row["has_empty"], first_keys)
