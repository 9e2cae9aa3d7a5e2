"""From match results to one target per column, for any number of source files at once.

Columns are (source_id, position, src_col); suggestions are (source_id, position, input_field, target, score,
src_match); a mapping is (source_id, position, src_col, target) with '(Ignored)' where nothing was chosen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemalign.functions import text
from schemalign.operators import skew
from schemalign.operators.settle import settle
from schemalign.plans.field_match import SCORES, field_match

MAPPING_THRESHOLD = 0.3
MATCH_THRESHOLD = 0.1


def auto_map(columns: DataFrame, dictionary: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """The best match of every column that scores at least the threshold, as suggestions."""
    best = field_match(columns, dictionary, 1, threshold, input_col="src_col")
    return best.select(
        "source_id", "position", F.col("src_col").alias("input_field"), F.col("target_field").alias("target"),
        F.col("combined_score").alias("score"), F.col("src_field").alias("src_match"),
    )


def suggestion_for(columns: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Columns with target, score and src_match of their suggestion: by exact name, else ignoring case.

    Where several suggestions share a name, the one of the later column counts.
    """
    answer = F.struct("position", "target", "score", "src_match")
    exact = settle(suggestions.groupBy("source_id", F.col("input_field").alias("src_col")).agg(F.max(answer).alias("exact")))
    folded = exact.groupBy("source_id", F.lower("src_col").alias("folded")).agg(F.max("exact").alias("other"))
    found = F.coalesce("exact", "other")
    named = skew.looked_up(columns, _flat(exact, "exact"), ["source_id", "src_col"], "left").withColumn("exact", _struct("exact"))
    named = skew.looked_up(named.withColumn("folded", F.lower("src_col")), _flat(folded, "other"), ["source_id", "folded"], "left")
    return named.withColumn("other", _struct("other")).select(
        *columns.columns, found["target"].alias("target"), found["score"].alias("score"), found["src_match"].alias("src_match")
    )


_ANSWER = ("position", "target", "score", "src_match")


def _flat(df: DataFrame, name: str) -> DataFrame:
    """The fields of a struct as columns of their own, whose size can be measured."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *[F.col(f"{name}.{f}").alias(f"_{name}_{f}") for f in _ANSWER])


def _struct(name: str) -> Column:
    fields = F.struct(*[F.col(f"_{name}_{f}").alias(f) for f in _ANSWER])
    return F.when(F.col(f"_{name}_position").isNotNull(), fields)


def valid_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows whose target is one of the known targets."""
    return skew.looked_up(df, targets.select("target").distinct(), ["target"], "left_semi").select(*df.columns)


def select_mapping(
    columns: DataFrame, suggestions: DataFrame, targets: DataFrame, threshold: float = MAPPING_THRESHOLD
) -> DataFrame:
    """The mapping: the suggested target if it is a known one and scores at least the threshold, else '(Ignored)'."""
    known = targets.select("target").distinct().withColumn("known", F.lit(True))
    suggested = skew.looked_up(suggestion_for(columns, suggestions), known, ["target"], "left")
    accepted = F.col("known") & (F.col("score") >= threshold)
    return suggested.select(
        "source_id", "position", "src_col", F.when(accepted, F.col("target")).otherwise(F.lit(text.IGNORED)).alias("target"),
        "score", F.when(accepted, F.col("src_match")).alias("src_match"),
    )


def _chosen(mapping: DataFrame) -> DataFrame:
    return mapping.filter(F.col("target") != text.IGNORED)


def duplicate_targets(mapping: DataFrame) -> DataFrame:
    """Columns that share their target with others of their file: (source_id, target, position, src_col, n_columns).

    One row per column, so a target chosen by any number of columns is told in full without a list that grows with it.
    """
    chosen = settle(_chosen(mapping).select("source_id", "target", "position", "src_col"))
    counts = settle(chosen.groupBy("source_id", "target").agg(F.count(F.lit(1)).alias("rows")))
    shared = counts.filter("rows > 1").select("source_id", "target", F.col("rows").alias("n_columns"))
    return skew.looked_up(chosen, shared, ["source_id", "target"], counts=counts).select(*chosen.columns, "n_columns")


def also_mapped_by(mapping: DataFrame, asked: DataFrame) -> DataFrame:
    """For the columns asked for, (source_id, position), the other columns that have their target.

    (source_id, position, src_col, target, n_others, other_position, other_col): one row per column asked for and other
    column, so the result grows with what is asked, not with the square of a target's columns.
    """
    shared = settle(duplicate_targets(mapping).withColumn("shared", F.struct("source_id", "target")))
    wanted = skew.looked_up(shared, asked.select("source_id", "position").distinct(), ["source_id", "position"])
    others = shared.select("shared", F.col("position").alias("other_position"), F.col("src_col").alias("other_col"))
    met = skew.salted_grid_join(wanted, others, "shared", skew.ROWS_PER_TASK)
    return met.filter("position <> other_position").select(
        "source_id", "position", "src_col", "target", (F.col("n_columns") - 1).alias("n_others"), "other_position", "other_col"
    )


def mapping_summary(mapping: DataFrame) -> DataFrame:
    """Per file: mapped, ignored and all columns, and whether it is ready (something mapped, no target twice)."""
    per_target = mapping.groupBy("source_id", "target").agg(F.count(F.lit(1)).alias("n"))
    mapped = F.col("target") != text.IGNORED
    return (
        per_target.groupBy("source_id")
        .agg(
            F.sum(F.when(mapped, F.col("n")).otherwise(0)).alias("mapped"),
            F.sum(F.when(mapped, 0).otherwise(F.col("n"))).alias("ignored"),
            F.sum("n").alias("total"),
            F.count_if(mapped & (F.col("n") > 1)).alias("duplicate_targets"),
        )
        .withColumn("ready", (F.col("mapped") > 0) & (F.col("duplicate_targets") == 0))
    )


def mapped_ignored(mapping: DataFrame) -> DataFrame:
    """The review rows: every column with its target and status."""
    mapped = F.col("target") != text.IGNORED
    return mapping.select(
        "source_id", "position", "src_col", F.when(mapped, F.col("target")).alias("target"),
        F.when(mapped, "Mapped").otherwise("Ignored").alias("status"),
    )


def status_counts(review: DataFrame) -> DataFrame:
    return review.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("columns"))


def matches_above(columns: DataFrame, suggestions: DataFrame, threshold: float = MAPPING_THRESHOLD) -> DataFrame:
    """Per file: how many of its columns have a suggestion scoring at least the threshold."""
    return (
        suggestion_for(columns, suggestions)
        .groupBy("source_id")
        .agg(F.count_if(F.col("score") >= threshold).alias("above"), F.count(F.lit(1)).alias("total"))
    )


def match_metrics(results: DataFrame) -> DataFrame:
    """One row: all matches and those of each confidence band."""
    band = text.confidence_band(F.col("combined_score"))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(band == name).alias(name.lower()) for name in ("High", "Medium", "Low")],
    )


def add_confidence_level(results: DataFrame) -> DataFrame:
    """Scores rounded for display, with the confidence band of the score as computed."""
    banded = results.withColumn("confidence_level", text.confidence_band(F.col("combined_score")))
    return banded.withColumns({name: F.bround(name, 3) for name in SCORES if name in results.columns})


def best_match(results: DataFrame, by: Sequence[str] = ("input_field",)) -> DataFrame:
    """The best row per input, the first one of equal scores."""
    order = Window.partitionBy(*by).orderBy(F.col("combined_score").desc(), F.col("match_rank"))
    return results.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == 1).drop("nth")


def needs_attention(results: DataFrame, by: Sequence[str] = ("input_field",)) -> DataFrame:
    return best_match(results, by).filter(F.col("combined_score") < text.MEDIUM_CONFIDENCE)
