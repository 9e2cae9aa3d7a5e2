"""Shared by the registered queries: table access and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemalign.operators.settle import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_cores(df: DataFrame) -> DataFrame:
    """Rows dealt out where a table has so few splits that most cores would wait; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh_folder(spark: SparkSession) -> str:
    return new_folder(spark, "queries")


def norm_sql(expr: str) -> str:
    return (
        f"coalesce(trim(regexp_replace(regexp_replace(lower({expr}), "
        r"'[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '')"
    )


def words_sql(expr: str) -> str:
    return f"list_filter(string_split({expr}, ' '), lambda x: x <> '')"


def overlap_sql(a: str, b: str) -> str:
    shared = f"len(list_intersect({words_sql(a)}, {words_sql(b)}))"
    union = f"len(list_distinct(list_concat({words_sql(a)}, {words_sql(b)})))"
    return f"(CASE WHEN {union} > 0 THEN {shared}::DOUBLE / {union} ELSE 0.0 END)"


def inside_sql(a: str, b: str) -> str:
    return f"(CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def ratio_ctes(pairs: str, longest: int) -> str:
    """CTEs giving ratios(a, b, seq) for the distinct pairs (a, b) of the named relation, names up to `longest`.

    Every step splits each open stretch at its longest common block, the earliest one in a, then in b.
    """
    bound = longest + 1
    return f"""
    blocks(a0, b0, a, b, path, k) AS (
      SELECT a, b, a, b, '', 0 FROM (SELECT DISTINCT a, b FROM {pairs})
      UNION ALL
      SELECT a0, b0,
             unnest([substr(a, 1, m.i - 1), substr(a, m.i + m.k, 999)]),
             unnest([substr(b, 1, m.j - 1), substr(b, m.j + m.k, 999)]),
             path || unnest(['l', 'r']), unnest([m.k, 0])
      FROM (
        SELECT a0, b0, a, b, path, max({{'k': k2, 'ni': -i, 'nj': -j, 'i': i, 'j': j}}) AS m
        FROM (
          SELECT s.a0, s.b0, s.a, s.b, s.path, i.i::INT AS i, j.j::INT AS j, l.l::INT AS k2
          FROM blocks s, range(1, {bound}) i(i), range(1, {bound}) j(j), range(1, {bound}) l(l)
          WHERE i.i + l.l - 1 <= length(s.a) AND j.j + l.l - 1 <= length(s.b)
            AND substr(s.a, i.i, 1) = substr(s.b, j.j, 1)
            AND substr(s.a, i.i, l.l) = substr(s.b, j.j, l.l)
        )
        GROUP BY ALL
      )
    ),
    ratios AS (
      SELECT a0 AS a, b0 AS b,
             CASE WHEN length(a0) + length(b0) = 0 THEN 1.0 ELSE 2.0 * sum(k) / (length(a0) + length(b0)) END::DOUBLE AS seq
      FROM blocks GROUP BY a0, b0
    )"""


def tfidf_ctes(docs: str, queries: str) -> str:
    """CTEs vocab(term, tf, df, n_docs, idf) of docs(b, one row per document) and cosines(a, b, cosine)."""

    def grams(relation: str, col: str) -> str:
        return f"""
        SELECT {col}, unnest(list_concat(
            t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
            list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term
        FROM (SELECT {col}, list_filter(string_split({col}, ' '), lambda x: length(x) >= 2) AS t FROM {relation})"""

    return f"""
    numbered AS (SELECT b, row_number() OVER () AS doc FROM {docs}),
    doc_grams AS (
      SELECT doc, b, unnest(list_concat(
            t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
            list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term
      FROM (SELECT doc, b, list_filter(string_split(b, ' '), lambda x: length(x) >= 2) AS t FROM numbered)
    ),
    vocab AS (
      SELECT term, tf, df, n_docs, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
      FROM (SELECT term, count(*) AS tf, count(DISTINCT doc) AS df FROM doc_grams GROUP BY term),
           (SELECT count(*) AS n_docs FROM numbered)
      ORDER BY tf DESC, term LIMIT 1000
    ),
    doc_raw AS (SELECT b, term, count(*) * any_value(idf) AS w
                FROM ({grams(f'(SELECT DISTINCT b FROM {docs})', 'b')}) JOIN vocab USING (term) GROUP BY b, term),
    doc_w AS (SELECT b, term, w / sqrt(sum(w * w) OVER (PARTITION BY b)) AS w FROM doc_raw),
    query_raw AS (SELECT a, term, count(*) * any_value(idf) AS w
                  FROM ({grams(f'(SELECT DISTINCT a FROM {queries})', 'a')}) JOIN vocab USING (term) GROUP BY a, term),
    query_w AS (SELECT a, term, w / sqrt(sum(w * w) OVER (PARTITION BY a)) AS w FROM query_raw),
    cosines AS (SELECT a, b, sum(q.w * d.w) AS cosine FROM query_w q JOIN doc_w d USING (term) GROUP BY a, b)"""


def match_sql(inputs: str, dictionary: str, keep: str, top_n: int, threshold: float, longest: int) -> str:
    """The whole matcher: inputs has the columns `keep` and input_field; dictionary distinct (src, target).

    Pairs whose score stays under the threshold even with a sequence ratio of 1 are not given to the block search.
    """
    return f"""
    WITH RECURSIVE inputs AS ({inputs}), dict AS ({dictionary}),
    names AS (SELECT DISTINCT {norm_sql('input_field')} AS a FROM inputs),
    keys AS (SELECT src, target, {norm_sql('src')} AS b FROM dict),
    {tfidf_ctes('keys', 'names')},
    scored AS (
      SELECT a, b, src, target, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e, {inside_sql('a', 'b')} AS s,
             {overlap_sql('a', 'b')} AS o, coalesce(cosine, 0.0) AS c
      FROM names CROSS JOIN keys LEFT JOIN cosines USING (a, b)
    ),
    hopeful AS (
      SELECT * FROM scored WHERE (e * 0.4 + s * 0.2 + 0.2 + o * 0.2) * 0.7 + c * 0.3 >= {threshold} - 1e-6
    ),
    {ratio_ctes('hopeful', longest)},
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(combined, 10) DESC, src) AS match_rank
      FROM (SELECT *, (e * 0.4 + s * 0.2 + seq * 0.2 + o * 0.2) * 0.7 + c * 0.3 AS combined
            FROM hopeful JOIN ratios USING (a, b))
      WHERE combined >= {threshold}
    ),
    matches AS (
      SELECT {keep}, input_field, src AS src_field, target AS target_field, round_even(combined, 4) AS combined_score,
             e AS exact_score, s AS substring_score, round_even(seq, 4) AS sequence_score,
             round_even(o, 4) AS word_overlap, round_even(c, 4) AS tfidf_score, match_rank::INTEGER AS match_rank
      FROM inputs JOIN ranked ON {norm_sql('input_field')} = a WHERE match_rank <= {top_n}
    )
    """


def swapped(name: str = "p_name") -> Column:
    """'blue bolt' -> 'bolt-blue'."""
    parts = F.split(name, " ")
    return F.concat_ws("-", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


SWAPPED_SQL = "split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1)"
