"""Dictionary maintenance: two snapshots of the orders as (src, target, description), and the part names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.common import table
from schemalign.operators import dictionary as d
from schemalign.operators.search import build_search_index, search_index
from schemalign.sources import versions

# Pairs of customer and priority repeat, with different descriptions.
OLD_SQL = """
SELECT o_custkey::VARCHAR AS src, o_orderpriority AS target, o_orderstatus AS description
FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01'"""
NEW_SQL = """
SELECT o_custkey::VARCHAR AS src, o_orderpriority AS target,
       CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderstatus END AS description
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'"""
# One update per key.
UPDATES_SQL = f"SELECT src, target, max(description) || '+' AS description FROM ({NEW_SQL}) GROUP BY src, target"
DOOMED_SQL = """
SELECT DISTINCT o_custkey::VARCHAR AS src, o_orderpriority AS target FROM orders WHERE o_totalprice > 300000"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns(
        {"src": F.col("o_custkey").cast("string"), "target": F.col("o_orderpriority")}
    )


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).filter(F.col("o_orderdate") < F.lit("1999-06-01").cast("timestamp")).select(
        "src", "target", F.col("o_orderstatus").alias("description")
    )


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = F.when(F.col("o_totalprice") >= 100000, F.col("o_orderstatus"))
    return _orders(spark, sf_dir).filter(F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp")).select(
        "src", "target", described.alias("description")
    )


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new(spark, sf_dir).groupBy("src", "target").agg(F.concat(F.max("description"), F.lit("+")).alias("description"))


def _doomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).filter("o_totalprice > 300000").select("src", "target").distinct()


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their types, and every type as a row of its own (src = target)."""
    part = table(spark, sf_dir, "part")
    named = part.select(F.col("p_name").alias("src"), F.col("p_type").alias("target"))
    return named.unionByName(part.select(F.col("p_type").alias("src"), F.col("p_type").alias("target")))


PARTS_SQL = "SELECT p_name AS src, p_type AS target FROM part UNION ALL SELECT p_type, p_type FROM part"


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.insert_if_absent(_old(spark, sf_dir), _new(spark, sf_dir))


def insert_two_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with two values: what is inserted is one of the new rows, not a mixture."""

    def valued(df: DataFrame) -> DataFrame:
        return df.withColumn("clerk", F.when(F.col("description") == "F", "a").when(F.col("description") == "O", "z"))

    return d.insert_if_absent(valued(_old(spark, sf_dir)), valued(_new(spark, sf_dir)).withColumn("description", F.reverse("clerk")))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.upsert(_old(spark, sf_dir), _updates(spark, sf_dir), ["src", "target"], ["description"])


def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.delete_keys(_old(spark, sf_dir), _doomed(spark, sf_dir))


def delete_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _parts(spark, sf_dir).filter("src LIKE 'S%' OR src LIKE 'blue%'").select("src").distinct()
    return d.delete_keys(_parts(spark, sf_dir), types, keys=["src"], protect_identity=True)


def published_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a published dictionary: the old orders, the updates put in, the doomed pairs taken out."""
    name = f"orders_{uuid.uuid4().hex[:12]}"
    versions.publish(_old(spark, sf_dir), name, d.KEYS)
    versions.republish(spark, name, lambda base: d.upsert(base, _updates(spark, sf_dir), d.KEYS, ["description"]))
    versions.republish(spark, name, lambda base: d.delete_keys(base, _doomed(spark, sf_dir)))
    return spark.table(name)


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by a regular expression over an index of the names' grams."""
    index = build_search_index(_parts(spark, sf_dir), f"parts_{uuid.uuid4().hex[:12]}")
    return search_index(index, "^(RED|s.*l) .*nut").unionByName(search_index(index, "gear$|^b.u"))


def deleted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.deleted_count(_old(spark, sf_dir), _doomed(spark, sf_dir))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.snapshot_diff(_old(spark, sf_dir), _new(spark, sf_dir))


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.change_counts(snapshot_diff(spark, sf_dir))


def apply_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.apply_diff(_old(spark, sf_dir), snapshot_diff(spark, sf_dir))


def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.except_keys(_old(spark, sf_dir), _new(spark, sf_dir))


def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.common_keys(_old(spark, sf_dir), _new(spark, sf_dir))


def merge_filtered_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _old(spark, sf_dir)
    shown = F.col("target").isin("1-URGENT", "2-HIGH") & d.source_matches("7$")
    edited = base.filter(shown).withColumn("description", F.lower("description"))
    return d.merge_filtered_edit(base, shown, edited)


def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = _new(spark, sf_dir).select(F.col("description").alias("src"), "target")
    return d.dictionary_stats(_parts(spark, sf_dir).unionByName(missing))


def distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.distinct_targets(_parts(spark, sf_dir))


def search_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.search_src(_parts(spark, sf_dir), "^(RED|s.*l) .*(in|DG)")


def filter_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.filter_targets(_parts(spark, sf_dir), ["ECONOMY", "PROMO", "absent"])


def filter_targets_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "part").filter("p_type LIKE '%M%'").select(F.col("p_type").alias("target"))
    return d.filter_targets(_parts(spark, sf_dir), chosen)


def deletable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    without = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("src"), F.lit(None).cast("string").alias("target"))
    return d.deletable_sources(_parts(spark, sf_dir).unionByName(without))


_ONE_EACH = "SELECT src, target, min(coalesce(description, '')) AS v FROM ({}) GROUP BY src, target"
DIFF_SQL = f"""
SELECT src, target, o.v AS old_value, n.v AS new_value,
       CASE WHEN n.v IS NULL THEN 'delete' WHEN o.v IS NULL THEN 'insert' WHEN o.v <> n.v THEN 'update' ELSE 'same' END AS change
FROM ({_ONE_EACH.format(OLD_SQL)}) o FULL JOIN ({_ONE_EACH.format(NEW_SQL)}) n USING (src, target)"""

QUERIES = {
    "insert_if_absent": insert_if_absent,
    "insert_two_values": insert_two_values,
    "upsert": upsert,
    "delete_keys": delete_keys,
    "delete_sources": delete_sources,
    "published_changes": published_changes,
    "search_indexed": search_indexed,
    "deleted_count": deleted_count,
    "snapshot_diff": snapshot_diff,
    "change_counts": change_counts,
    "apply_diff": apply_diff,
    "except_keys": except_keys,
    "common_keys": common_keys,
    "merge_filtered_edit": merge_filtered_edit,
    "dictionary_stats": dictionary_stats,
    "distinct_targets": distinct_targets,
    "search_src": search_src,
    "filter_targets": filter_targets,
    "filter_targets_listed": filter_targets_listed,
    "deletable_sources": deletable_sources,
}
ORACLES = {
    "insert_if_absent": f"""
WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}) SELECT * FROM o UNION ALL
SELECT src, target, min(description) FROM n WHERE (src, target) NOT IN (SELECT (src, target) FROM o) GROUP BY src, target""",
    "insert_two_values": f"""
WITH clerks AS (SELECT 'F' AS description, 'a' AS clerk UNION ALL SELECT 'O', 'z'),
o AS (SELECT src, target, description, clerk FROM ({OLD_SQL}) LEFT JOIN clerks USING (description)),
n AS (SELECT src, target, clerk AS description, clerk FROM ({NEW_SQL}) LEFT JOIN clerks USING (description))
SELECT * FROM o UNION ALL
SELECT * FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY src, target ORDER BY description NULLS LAST, clerk NULLS LAST) = 1)
WHERE (src, target) NOT IN (SELECT (src, target) FROM o)""",
    "upsert": f"""
WITH o AS ({OLD_SQL}), u AS ({UPDATES_SQL})
SELECT o.src, o.target, CASE WHEN u.src IS NULL THEN o.description ELSE u.description END AS description
FROM o LEFT JOIN u USING (src, target) UNION ALL
SELECT src, target, description FROM u WHERE (src, target) NOT IN (SELECT (src, target) FROM o)""",
    "delete_keys": f"WITH x AS ({DOOMED_SQL}) SELECT * FROM ({OLD_SQL}) WHERE (src, target) NOT IN (SELECT (src, target) FROM x)",
    "published_changes": f"""
WITH o AS ({OLD_SQL}), u AS ({UPDATES_SQL}), x AS ({DOOMED_SQL}),
merged AS (
  SELECT o.src, o.target, CASE WHEN u.src IS NULL THEN o.description ELSE u.description END AS description
  FROM o LEFT JOIN u USING (src, target) UNION ALL
  SELECT src, target, description FROM u WHERE (src, target) NOT IN (SELECT (src, target) FROM o))
SELECT * FROM merged WHERE (src, target) NOT IN (SELECT (src, target) FROM x)""",
    "search_indexed": f"""
SELECT * FROM ({PARTS_SQL}) WHERE regexp_matches(src, '(?i)^(RED|s.*l) .*nut')
UNION ALL SELECT * FROM ({PARTS_SQL}) WHERE regexp_matches(src, '(?i)gear$|^b.u')""",
    "delete_sources": f"""
SELECT * FROM ({PARTS_SQL}) WHERE src = target OR NOT (src LIKE 'S%' OR src LIKE 'blue%')""",
    "deleted_count": f"""
WITH x AS ({DOOMED_SQL}) SELECT count(*) AS deleted FROM ({OLD_SQL}) WHERE (src, target) IN (SELECT (src, target) FROM x)""",
    "snapshot_diff": DIFF_SQL,
    "change_counts": f"SELECT change, count(*) AS keys FROM ({DIFF_SQL}) GROUP BY change",
    "apply_diff": f"""
WITH o AS ({OLD_SQL}), x AS ({DIFF_SQL})
SELECT src, target, CASE WHEN change = 'update' THEN new_value ELSE description END AS description
FROM o JOIN x USING (src, target) WHERE change <> 'delete' UNION ALL
SELECT src, target, new_value FROM x WHERE change = 'insert'""",
    "except_keys": f"SELECT src, target FROM ({OLD_SQL}) EXCEPT SELECT src, target FROM ({NEW_SQL})",
    "common_keys": f"SELECT src, target FROM ({OLD_SQL}) INTERSECT SELECT src, target FROM ({NEW_SQL})",
    "merge_filtered_edit": f"""
SELECT src, target, CASE WHEN target IN ('1-URGENT', '2-HIGH') AND src LIKE '%7' THEN lower(description) ELSE description END
       AS description FROM ({OLD_SQL})""",
    "dictionary_stats": f"""
SELECT count(*) AS total_mappings, count(DISTINCT target) AS unique_targets,
       count(DISTINCT src) + max((src IS NULL)::INT) AS unique_sources
FROM ({PARTS_SQL} UNION ALL SELECT description, target FROM ({NEW_SQL}))""",
    "distinct_targets": f"SELECT DISTINCT target FROM ({PARTS_SQL}) WHERE target IS NOT NULL ORDER BY target",
    "search_src": f"SELECT * FROM ({PARTS_SQL}) WHERE regexp_matches(src, '(?i)^(RED|s.*l) .*(in|DG)')",
    "filter_targets": f"SELECT * FROM ({PARTS_SQL}) WHERE target IN ('ECONOMY', 'PROMO', 'absent')",
    "filter_targets_listed": f"SELECT * FROM ({PARTS_SQL}) WHERE target LIKE '%M%'",
    "deletable_sources": f"""
SELECT DISTINCT src FROM ({PARTS_SQL} UNION ALL SELECT s_name, NULL FROM supplier) WHERE src IS DISTINCT FROM target AND src IS NOT NULL
ORDER BY src""",
}
