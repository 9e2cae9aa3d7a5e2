"""Suggestions, mappings and their summaries, for many source files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.common import SWAPPED_SQL, match_sql, swapped, table
from queries.matching import TYPE_OF_NAME, part_dictionary
from schemalign.functions import text
from schemalign.operators import mapping as m

# A source file is a brand with a size; its columns are its parts, named in one of three styles.
SOURCE_SQL = "p_brand || '/' || p_size"
STYLED_SQL = (
    f"CASE WHEN p_size < 17 THEN {SWAPPED_SQL} WHEN p_size < 34 THEN replace(upper(p_name), ' ', '_') "
    "ELSE p_name || '!' END"
)


def _styled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = (
        F.when(F.col("p_size") < 17, swapped())
        .when(F.col("p_size") < 34, F.replace(F.upper("p_name"), F.lit(" "), F.lit("_")))
        .otherwise(F.concat("p_name", F.lit("!")))
    )
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", "p_size").alias("source_id"), F.col("p_partkey").alias("position"), name.alias("src_col")
    )


def auto_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.auto_map(_styled_columns(spark, sf_dir), part_dictionary(spark, sf_dir))


AUTO_MAP_SQL = (
    match_sql(
        f"SELECT {SOURCE_SQL} AS source_id, p_partkey AS position, {STYLED_SQL} AS input_field FROM part",
        TYPE_OF_NAME, "source_id, position", 1, 0.1, 12,
    )
    + "SELECT source_id, position, input_field, target_field AS target, combined_score AS score, "
    "src_field AS src_match FROM matches"
)


# Columns and suggestions that do not depend on the matcher, so that the operators after it are checked by themselves.
COLUMNS_SQL = f"""
SELECT {SOURCE_SQL} AS source_id, p_partkey AS position,
       CASE WHEN p_size < 17 THEN upper(p_name) ELSE p_name END AS src_col FROM part"""
SUGGESTIONS_SQL = f"""
SELECT {SOURCE_SQL} AS source_id, p_partkey AS position, p_name AS input_field, p_type AS target,
       least(p_retailprice - 900, 50.0 + p_size) / 100.0 AS score, lower(p_type) AS src_match
FROM part WHERE p_size >= 5"""
TARGETS_SQL = "SELECT DISTINCT p_type AS target FROM part WHERE p_type <> 'PROMO'"
FOUND_SQL = f"""
WITH cols AS ({COLUMNS_SQL}), sugg AS ({SUGGESTIONS_SQL}), targets AS ({TARGETS_SQL}),
exact AS (SELECT source_id, input_field AS src_col, max({{'position': position, 'target': target, 'score': score, 'src_match': src_match}}) AS x
          FROM sugg GROUP BY ALL),
other AS (SELECT source_id, lower(input_field) AS low, max({{'position': position, 'target': target, 'score': score, 'src_match': src_match}}) AS y
          FROM sugg GROUP BY ALL),
found AS (SELECT c.source_id, c.position, c.src_col, coalesce(x, y).target AS target, coalesce(x, y).score AS score,
                 coalesce(x, y).src_match AS src_match
          FROM cols c LEFT JOIN exact e ON e.source_id = c.source_id AND e.src_col = c.src_col
          LEFT JOIN other o ON o.source_id = c.source_id AND o.low = lower(c.src_col)),
mapping AS (SELECT source_id, position, src_col,
                   CASE WHEN score >= 0.3 AND target IN (SELECT target FROM targets) THEN target ELSE '(Ignored)' END AS target,
                   score,
                   CASE WHEN score >= 0.3 AND target IN (SELECT target FROM targets) THEN src_match END AS src_match
            FROM found)"""


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") < 17, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", "p_size").alias("source_id"), F.col("p_partkey").alias("position"), name.alias("src_col")
    )


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.least(F.col("p_retailprice") - 900, 50.0 + F.col("p_size")) / 100.0
    return table(spark, sf_dir, "part").filter("p_size >= 5").select(
        F.concat_ws("/", "p_brand", "p_size").alias("source_id"), F.col("p_partkey").alias("position"), F.col("p_name").alias("input_field"),
        F.col("p_type").alias("target"), score.alias("score"), F.lower("p_type").alias("src_match"),
    )


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("target")).filter("target <> 'PROMO'").distinct()


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.select_mapping(_columns(spark, sf_dir), _suggestions(spark, sf_dir), _targets(spark, sf_dir))


def suggestion_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.suggestion_for(_columns(spark, sf_dir), _suggestions(spark, sf_dir))


def select_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapping(spark, sf_dir)


def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.valid_targets(_suggestions(spark, sf_dir), _targets(spark, sf_dir))


def duplicate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.duplicate_targets(_mapping(spark, sf_dir))


def also_mapped_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for the first column of every file and target."""
    mapping = _mapping(spark, sf_dir)
    return m.also_mapped_by(mapping, mapping.groupBy("source_id", "target").agg(F.min("position").alias("position")))


def mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mapping_summary(_mapping(spark, sf_dir))


def mapped_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mapped_ignored(_mapping(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.status_counts(m.mapped_ignored(_mapping(spark, sf_dir)))


def matches_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.matches_above(_columns(spark, sf_dir), _suggestions(spark, sf_dir), 0.45)


DUPLICATES_SQL = """
, shared AS (SELECT source_id, target, position, src_col, count(*) OVER (PARTITION BY source_id, target) AS n_columns
             FROM mapping WHERE target <> '(Ignored)' QUALIFY n_columns > 1)"""

# Match results with a score and a rank, made from the order lines.
RESULTS_SQL = """
SELECT l_orderkey::VARCHAR AS input_field, l_partkey::VARCHAR AS src_field, l_linenumber AS match_rank,
       l_quantity / 50.0 AS combined_score, l_tax AS exact_score, l_extendedprice / 100000.0 AS tfidf_score FROM lineitem"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("input_field"), F.col("l_partkey").cast("string").alias("src_field"),
        F.col("l_linenumber").alias("match_rank"), (F.col("l_quantity") / 50.0).alias("combined_score"),
        F.col("l_tax").alias("exact_score"), (F.col("l_extendedprice") / 100000.0).alias("tfidf_score"),
    )


def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.match_metrics(_results(spark, sf_dir))


def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.add_confidence_level(_results(spark, sf_dir))


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.best_match(_results(spark, sf_dir)).select("input_field", "combined_score", "match_rank")


def needs_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.needs_attention(_results(spark, sf_dir)).select("input_field", "combined_score", "match_rank")


BANDS_SQL = "CASE WHEN combined_score >= 0.8 THEN 'High' WHEN combined_score >= 0.5 THEN 'Medium' ELSE 'Low' END"
BEST_SQL = f"""
SELECT input_field, combined_score, match_rank FROM ({RESULTS_SQL})
QUALIFY row_number() OVER (PARTITION BY input_field ORDER BY combined_score DESC, match_rank) = 1"""

QUERIES = {
    "auto_map": auto_map,
    "suggestion_for": suggestion_for,
    "select_mapping": select_mapping,
    "valid_targets": valid_targets,
    "duplicate_targets": duplicate_targets,
    "also_mapped_by": also_mapped_by,
    "mapping_summary": mapping_summary,
    "mapped_ignored": mapped_ignored,
    "status_counts": status_counts,
    "matches_above": matches_above,
    "match_metrics": match_metrics,
    "confidence_levels": confidence_levels,
    "best_match": best_match,
    "needs_attention": needs_attention,
}
ORACLES = {
    "auto_map": AUTO_MAP_SQL,
    "suggestion_for": FOUND_SQL + "SELECT * FROM found",
    "select_mapping": FOUND_SQL + "SELECT * FROM mapping",
    "valid_targets": f"SELECT * FROM ({SUGGESTIONS_SQL}) WHERE target IN ({TARGETS_SQL})",
    "duplicate_targets": FOUND_SQL + DUPLICATES_SQL + """
SELECT * FROM shared""",
    "also_mapped_by": FOUND_SQL + DUPLICATES_SQL + """
, firsts AS (SELECT source_id, target, min(position) AS position FROM shared GROUP BY ALL)
SELECT s.source_id, s.position, s.src_col, s.target, s.n_columns - 1 AS n_others,
       o.position AS other_position, o.src_col AS other_col
FROM shared s JOIN firsts USING (source_id, target, position) JOIN shared o ON o.source_id = s.source_id AND o.target = s.target
WHERE o.position <> s.position""",
    "mapping_summary": FOUND_SQL + """, counts AS (SELECT source_id, target, count(*) AS n FROM mapping GROUP BY ALL)
SELECT source_id, sum(CASE WHEN target <> '(Ignored)' THEN n ELSE 0 END)::BIGINT AS mapped,
       sum(CASE WHEN target = '(Ignored)' THEN n ELSE 0 END)::BIGINT AS ignored, sum(n)::BIGINT AS total,
       count(*) FILTER (target <> '(Ignored)' AND n > 1) AS duplicate_targets,
       sum(CASE WHEN target <> '(Ignored)' THEN n ELSE 0 END) > 0
         AND count(*) FILTER (target <> '(Ignored)' AND n > 1) = 0 AS ready
FROM counts GROUP BY source_id""",
    "mapped_ignored": FOUND_SQL + """
SELECT source_id, position, src_col, nullif(target, '(Ignored)') AS target,
       CASE WHEN target = '(Ignored)' THEN 'Ignored' ELSE 'Mapped' END AS status FROM mapping""",
    "status_counts": FOUND_SQL + """
SELECT source_id, CASE WHEN target = '(Ignored)' THEN 'Ignored' ELSE 'Mapped' END AS status, count(*) AS columns
FROM mapping GROUP BY ALL""",
    "matches_above": FOUND_SQL + """
SELECT source_id, count(*) FILTER (score >= 0.45) AS above, count(*) AS total FROM found GROUP BY source_id""",
    "match_metrics": f"""
SELECT count(*) AS total, count(*) FILTER (combined_score >= 0.8) AS high,
       count(*) FILTER (combined_score >= 0.5 AND combined_score < 0.8) AS medium,
       count(*) FILTER (combined_score < 0.5) AS low FROM ({RESULTS_SQL})""",
    "confidence_levels": f"""
SELECT input_field, src_field, match_rank, round_even(combined_score, 3) AS combined_score,
       round_even(exact_score, 3) AS exact_score, round_even(tfidf_score, 3) AS tfidf_score,
       {BANDS_SQL} AS confidence_level FROM ({RESULTS_SQL})""",
    "best_match": BEST_SQL,
    "needs_attention": f"SELECT * FROM ({BEST_SQL}) WHERE combined_score < 0.5",
}
