"""Name handling, similarity measures, TF-IDF and the matcher."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.common import (
    SWAPPED_SQL,
    inside_sql,
    match_sql,
    norm_sql,
    over_cores,
    overlap_sql,
    ratio_ctes,
    swapped,
    table,
    tfidf_ctes,
    words_sql,
)
from schemalign.functions import text
from schemalign.functions.sequence import sequence_ratio
from schemalign.operators import names, tfidf
from schemalign.operators.dictionary import snapshot_diff
from schemalign.operators.lexicon import lookup_target
from schemalign.plans.field_match import field_match
from schemalign.plans.field_match import field_match_names as match_names
from schemalign.plans.match_index import MatchIndex, apply_changes, build_index, create_match_function

TYPE_OF_NAME = "SELECT p_name AS src, max(p_type) AS target FROM part GROUP BY p_name"


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("src")).agg(F.max("p_type").alias("target"))


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.lit("d").alias("kind"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("  "), F.upper("p_name"), F.lit("_No./"), F.col("p_brand")).alias("name"), F.lit("p").alias("kind")
    )
    return docs.unionByName(parts).select("kind", "id", text.normalize_name(F.col("name")).alias("clean"))


NORMALIZE_SQL = f"""
SELECT kind, id, {norm_sql('name')} AS clean FROM (
  SELECT doc_id AS id, text AS name, 'd' AS kind FROM documents
  UNION ALL SELECT p_partkey, '  ' || upper(p_name) || '_No./' || p_brand, 'p' FROM part)"""


def explode_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("input_fields"))
    return names.explode_inputs(talks)


EXPLODE_SQL = """
SELECT conv_id, turn, unnest(range(0, len(w)))::INTEGER AS pos, unnest(w) AS input_field
FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)"""


def parse_name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("list_id"), F.replace("text", F.lit(" "), F.lit(" \n")).alias("typed")
    )
    return names.parse_name_list(talks, "typed", manual=["extra", "la"])


NAME_LIST_SQL = r"""
WITH lists AS (
  SELECT conv_id || '/' || turn AS list_id,
         list_concat(list_filter(list_transform(string_split(replace(text, ' ', ' ' || chr(10)), chr(10)),
                                                lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
                                 lambda x: x <> ''), ['extra', 'la']) AS w
  FROM conversations),
names AS (SELECT list_id, unnest(range(0, len(w)))::INTEGER AS pos, unnest(w) AS input_field FROM lists)
SELECT list_id, input_field, min(pos) AS pos FROM names GROUP BY list_id, input_field"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name with that of the next part."""
    part = table(spark, sf_dir, "part").select("p_partkey", text.normalize_name(swapped()).alias("a"))
    following = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") - 1).alias("p_partkey"), text.normalize_name(F.concat_ws(" ", "p_name", "p_type")).alias("b")
    )
    return part.join(following, "p_partkey")


NEIGHBOURS_SQL = f"""
SELECT p.p_partkey, {norm_sql(SWAPPED_SQL.replace('p_name', 'p.p_name'))} AS a,
       {norm_sql("q.p_name || ' ' || q.p_type")} AS b
FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1"""


def word_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf_dir).select(
        "p_partkey",
        text.exact_score(a, b).alias("exact_score"),
        text.substring_score(a, b).alias("substring_score"),
        F.bround(text.word_overlap(a, b), 4).alias("word_overlap"),
        F.size(F.array_intersect(text.word_set(a), text.word_set(b))).alias("shared_words"),
        text.shared_characters("a", "b").alias("shared_characters"),
    )


WORD_OVERLAP_SQL = f"""
WITH pairs AS ({NEIGHBOURS_SQL})
SELECT p_partkey, (a = b)::INT::DOUBLE AS exact_score, {inside_sql('a', 'b')} AS substring_score,
       round_even({overlap_sql('a', 'b')}, 4) AS word_overlap,
       len(list_intersect({words_sql('a')}, {words_sql('b')}))::INTEGER AS shared_words,
       list_sum(list_transform(list_distinct(string_split(a, '')), lambda c:
         least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, '')))))::INTEGER AS shared_characters
FROM pairs"""


def sequence_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _neighbours(spark, sf_dir)
    distinct = pairs.select("a", "b").distinct().withColumn("sequence_score", F.bround(sequence_ratio("a", "b"), 4))
    return pairs.join(distinct, ["a", "b"]).select("p_partkey", "sequence_score")


SEQUENCE_SQL = f"""
WITH RECURSIVE pairs AS ({NEIGHBOURS_SQL}),
{ratio_ctes('pairs', 21)}
SELECT p_partkey, round_even(seq, 4) AS sequence_score FROM pairs JOIN ratios USING (a, b)"""


def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = over_cores(table(spark, sf_dir, "documents").select("text")).select(text.normalize_name(F.col("text")).alias("key"))
    every = docs.withColumn("copies", F.lit(1).cast("bigint"))
    return tfidf.fit_vocabulary(every).select("term", "tf", "df", "n_docs", F.bround("idf", 6).alias("idf"))


TERMS_SQL = f"""
WITH docs AS (SELECT {norm_sql('text')} AS b FROM documents), none AS (SELECT '' AS a),
{tfidf_ctes('docs', 'none')}
SELECT term, tf::BIGINT AS tf, df::BIGINT AS df, n_docs::BIGINT AS n_docs, round_even(idf, 6) AS idf FROM vocab"""


def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(text.normalize_name(F.col("s_name")).alias("key"))
    parts = part_dictionary(spark, sf_dir).select(text.normalize_name(F.concat_ws(" ", "src", "target")).alias("key"))
    documents = suppliers.unionByName(parts)
    customers = table(spark, sf_dir, "customer").select(text.normalize_name(F.col("c_name")).alias("key"))
    swaps = table(spark, sf_dir, "part").select(text.normalize_name(swapped()).alias("key"))
    queries = customers.unionByName(swaps).distinct()
    vocabulary = tfidf.cap_vocabulary(tfidf.fit_terms(documents.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))))
    found = tfidf.sparse_cosine(queries, documents.distinct(), vocabulary, 0.2)
    return found.withColumn("cosine", F.bround("cosine", 4))


COSINE_SQL = f"""
WITH docs AS (SELECT {norm_sql('s_name')} AS b FROM supplier
              UNION ALL SELECT {norm_sql("src || ' ' || target")} FROM ({TYPE_OF_NAME})),
names AS (SELECT {norm_sql('c_name')} AS a FROM customer UNION SELECT {norm_sql(SWAPPED_SQL)} FROM part),
{tfidf_ctes('docs', 'names')}
SELECT a AS input_key, b AS src_key, round_even(cosine, 4) AS cosine FROM cosines WHERE cosine >= 0.2 - 1e-9"""


def field_match_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "part").select("p_partkey", swapped().alias("input_field"))
    return field_match(inputs, part_dictionary(spark, sf_dir))


TOP3_SQL = (
    match_sql(f"SELECT p_partkey, {SWAPPED_SQL} AS input_field FROM part", TYPE_OF_NAME, "p_partkey", 3, 0.1, 12)
    + "SELECT * FROM matches"
)


def field_match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("input_field"))
    dictionary = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("src"), F.concat(F.lit("nation "), F.col("s_nationkey")).alias("target")
    )
    return field_match(inputs, dictionary, 2, 0.3)


NAMES_SQL = (
    match_sql(
        "SELECT c_custkey, c_name AS input_field FROM customer",
        "SELECT s_name AS src, 'nation ' || s_nationkey AS target FROM supplier",
        "c_custkey", 2, 0.3, 18,
    )
    + "SELECT * FROM matches"
)


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of one word each, alike in their characters only: all suppliers against all customers."""
    inputs = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("customer"), "s_suppkey", F.lit("x")).alias("input_field"))
    dictionary = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer"), "c_custkey").alias("src"), F.col("c_mktsegment").alias("target")
    )
    return inputs, dictionary


def field_match_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the default threshold; from sf0.1 on the dictionary is beyond what is broadcast."""
    return field_match(*_numbered(spark, sf_dir))


def field_match_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_match(*_numbered(spark, sf_dir), broadcast_keys=0)


def field_match_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call with a list of names."""
    _, dictionary = _numbered(spark, sf_dir)
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    return match_names(spark, [n.lower().replace("nation_", "customer") for n in names], dictionary, 2, 0.3)


def _called(index: MatchIndex, names: DataFrame, top_n: int, threshold: float) -> DataFrame:
    """SELECT * FROM field_match(array of the names, ...)."""
    create_match_function(index, f"{index.name}_match")
    names.createOrReplaceTempView(f"{index.name}_asked")
    listed = f"(SELECT collect_list(input_field) FROM {index.name}_asked)"
    return names.sparkSession.sql(f"SELECT * FROM {index.name}_match({listed}, {top_n}, {threshold}D)")


def field_match_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher as an SQL function over a kept index."""
    inputs, dictionary = _numbered(spark, sf_dir)
    return _called(build_index(dictionary, f"ix_{uuid.uuid4().hex[:12]}"), inputs, 3, 0.1)


def field_match_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the dictionary changed: names of customers go, come and get another target."""
    customers = table(spark, sf_dir, "customer").withColumn("description", F.lit(""))
    known = F.concat(F.lit("customer"), "c_custkey").alias("src")
    old = customers.filter("c_custkey % 3 <> 0").select(known, F.col("c_mktsegment").alias("target"), "description")
    named = F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    new = customers.filter("c_custkey % 4 <> 0").select(known, named.alias("target"), "description")
    index = build_index(old.select("src", "target"), f"ix_{uuid.uuid4().hex[:12]}")
    apply_changes(index, snapshot_diff(old, new))
    inputs, _ = _numbered(spark, sf_dir)
    return _called(index, inputs, 2, 0.1)


CHARACTERS_SQL = (
    match_sql(
        "SELECT s_suppkey, 'customer' || s_suppkey || 'x' AS input_field FROM supplier",
        "SELECT 'customer' || c_custkey AS src, c_mktsegment AS target FROM customer",
        "s_suppkey", 3, 0.1, 14,
    )
    + "SELECT * FROM matches"
)

LIST_SQL = (
    match_sql(
        "SELECT replace(lower(n_name), 'nation_', 'customer') AS input_field, n_nationkey FROM nation",
        "SELECT 'customer' || c_custkey AS src, c_mktsegment AS target FROM customer",
        "n_nationkey", 2, 0.3, 14,
    )
    + "SELECT * EXCLUDE (n_nationkey) FROM matches"
)


FUNCTION_SQL = CHARACTERS_SQL.replace("SELECT * FROM matches", "SELECT * EXCLUDE (s_suppkey) FROM matches")

KEPT_INDEX_SQL = (
    match_sql(
        "SELECT s_suppkey, 'customer' || s_suppkey || 'x' AS input_field FROM supplier",
        """SELECT 'customer' || c_custkey AS src, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS target
           FROM customer WHERE c_custkey % 4 <> 0""",
        "s_suppkey", 2, 0.1, 14,
    )
    + "SELECT * EXCLUDE (s_suppkey) FROM matches"
)


def _long(column: str) -> Column:
    """A name of more than 64 characters in one word, of the digits of a number."""
    digits = F.lpad(F.col(column).cast("string"), 6, "0")
    return F.concat(F.lit("x"), F.repeat(digits, 6), F.reverse(digits), F.repeat(F.lit("customer"), 4))


def field_match_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of 75 characters, alike in their characters only."""
    inputs = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(_long("s_suppkey"), F.lit("z")).alias("input_field"))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(_long("c_custkey").alias("src"), F.col("c_mktsegment").alias("target"))
    return field_match(inputs, known, 1, 0.125)


def lookup_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.when(F.col("p_size") < 25, F.col("p_name")).otherwise(F.upper("p_name")).alias("src"))
    return lookup_target(asked, part.select(F.col("p_name").alias("src"), F.col("p_type").alias("target")))


LOOKUP_SQL = f"""
SELECT p_partkey, src, coalesce(target, 'UNMAPPED') AS target_field
FROM (SELECT p_partkey, CASE WHEN p_size < 25 THEN p_name ELSE upper(p_name) END AS src FROM part)
LEFT JOIN ({TYPE_OF_NAME}) USING (src)"""

QUERIES = {
    "normalize_names": normalize_names,
    "explode_inputs": explode_inputs,
    "parse_name_list": parse_name_list,
    "word_overlap_pairs": word_overlap_pairs,
    "sequence_ratio_pairs": sequence_ratio_pairs,
    "tfidf_terms": tfidf_terms,
    "tfidf_cosine": tfidf_cosine,
    "field_match_top3": field_match_top3,
    "field_match_names": field_match_names,
    "field_match_characters": field_match_characters,
    "field_match_shuffled": field_match_shuffled,
    "field_match_list": field_match_list,
    "field_match_function": field_match_function,
    "field_match_kept_index": field_match_kept_index,
    "field_match_long": field_match_long,
    "lookup_target": lookup_targets,
}
ORACLES = {
    "normalize_names": NORMALIZE_SQL,
    "explode_inputs": EXPLODE_SQL,
    "parse_name_list": NAME_LIST_SQL,
    "word_overlap_pairs": WORD_OVERLAP_SQL,
    "sequence_ratio_pairs": SEQUENCE_SQL,
    "tfidf_terms": TERMS_SQL,
    "tfidf_cosine": COSINE_SQL,
    "field_match_top3": TOP3_SQL,
    "field_match_names": NAMES_SQL,
    "field_match_characters": CHARACTERS_SQL,
    "field_match_shuffled": CHARACTERS_SQL,
    "field_match_list": LIST_SQL,
    "field_match_function": FUNCTION_SQL,
    "field_match_kept_index": KEPT_INDEX_SQL,
    "lookup_target": LOOKUP_SQL,
}
