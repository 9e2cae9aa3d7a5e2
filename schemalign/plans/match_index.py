"""A kept index of the dictionary, and the matcher as an SQL table function over it.

The index is some tables. postings (probe, key) says under which probes a source name is met; that depends on the name
alone, so it is written once for a name, bucketed by probe. entries (src, target, n), terms (term, tf, df), vocabulary,
names (key, copies, rows, words, vec) and facts depend on the whole dictionary: a change adds the postings of new names and
writes the others as a next version, counting anew only what the change touches. Names that are gone keep their postings;
pairs are joined with the names that are there. Views without a version in their name are switched to the new tables, the
one that decides which names there are last.

The function's body is an equi-join of the probes of the names asked for with the postings; names that this does not give
enough for are compared by counts of characters with blocks of the source names. It gives what field_match gives for any
threshold from the index' least one on.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from schemalign.functions import text
from schemalign.functions.sequence import sequence_ratio
from schemalign.operators import characters, lexicon, probes, tfidf
from schemalign.operators.settle import settle
from schemalign.plans.field_match import KEYS_PER_TASK, common_grams, quoted_list, spread

# Answers a call may ask for, and the lowest threshold, unless the index is built for others.
MOST_ANSWERS = 10
LEAST_THRESHOLD = 0.1

# Postings are written anew once so many times their buckets are due.
_OUTGROWN = 4

# Names asked for that are compared with a block of source names in one call.
_RUN_NAMES = 16 * characters.LEFT_NAMES

_SIDES = ("entries", "terms", "vocabulary", "facts", "names")


@dataclass(frozen=True)
class MatchIndex:
    spark: SparkSession
    name: str

    def table(self, side: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{side}")


def _postings(keys: DataFrame, common: str) -> DataFrame:
    kinds = [
        probes.tagged("x", "array(key)"),
        probes.tagged("g", probes.all_grams("key")),
        probes.tagged("h", probes.one_gram("key", f"({probes.signature_grams('key', common)})")),
        probes.tagged("w", "filter(array_distinct(split(key, ' ')), w -> w <> '')"),
    ]
    return keys.filter("key <> ''").select(F.explode(F.array_distinct(F.expr(f"concat({', '.join(kinds)})"))).alias("probe"), "key")


def _shuffled_into(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _buckets(spark: SparkSession, n_keys: int) -> int:
    """Buckets for so many source names: as many as their scoring is worth, at most as many as the cluster shuffles into."""
    return min(max(math.ceil(n_keys / KEYS_PER_TASK), 1), _shuffled_into(spark))


def _save(df: DataFrame, table: str, bucketed: str | None = None, mode: str = "error", buckets: int = 1) -> None:
    if not bucketed:
        df.write.mode(mode).format("parquet").saveAsTable(table)
        return
    # Dealt as they are bucketed, so that a task writes one file.
    df.repartition(buckets, bucketed).write.mode(mode).format("parquet").bucketBy(buckets, bucketed).sortBy(bucketed).saveAsTable(table)


def _one_target(entries: DataFrame) -> DataFrame:
    """(src, target, n) -> (src, target, copies), as lexicon.last_target gives them."""
    return entries.groupBy("src").agg(F.max("target").alias("target"), F.sum("n").alias("copies"))


def _publish(spark: SparkSession, name: str, entries: DataFrame, terms: DataFrame, kept: dict) -> None:
    """Write the version that follows from entries (src, target, n) and terms (term, tf, df), then point to it."""
    made = {side: f"{name}_{side}_{uuid.uuid4().hex[:12]}" for side in _SIDES}
    _save(entries, made["entries"], "src", buckets=kept["buckets"])
    _save(terms, made["terms"], "term", buckets=kept["buckets"])
    sources = settle(lexicon.keyed_rows(_one_target(spark.table(made["entries"])), kept["most"]))
    size = sources.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("docs")).first()
    weighed = tfidf.with_idf(spark.table(made["terms"]).filter("tf > 0"), F.lit(size["docs"]))
    _save(tfidf.cap_vocabulary(weighed).select("term", "idf"), made["vocabulary"])
    known = lexicon.inspect(sources, 2 * kept["most"])
    vectors = tfidf.weigh(spread(sources.select("key"), size["keys"]), spark.table(made["vocabulary"]))
    named = sources.join(vectors.select("key", tfidf.vector("entries").alias("vec")), "key")
    _save(named.select("key", "copies", "rows", text.word_set(F.col("key")).alias("words"), "vec"), made["names"], "key", buckets=kept["buckets"])
    row = (known.has_terms, known.has_empty, known.first_keys, *[kept[k] for k in ("common", "least", "most", "postings", "buckets")])
    schema = (
        "has_terms boolean, has_empty boolean, first_keys array<string>, common string, least double, most int, postings string, buckets int"
    )
    _save(spark.createDataFrame([row], schema), made["facts"])
    for side in _SIDES:
        spark.sql(f"CREATE OR REPLACE VIEW {name}_{side} AS SELECT * FROM {made[side]}")


def build_index(
    dictionary: DataFrame, name: str, least_threshold: float = LEAST_THRESHOLD, most_answers: int = MOST_ANSWERS
) -> MatchIndex:
    """Write the index of a dictionary (src, target) under this name, replacing one that is there."""
    if least_threshold <= 0:
        raise ValueError("least_threshold must be positive")
    spark = dictionary.sparkSession
    entries = settle(dictionary.groupBy("src", "target").agg(F.count(F.lit(1)).alias("n")))
    settled = settle(lexicon.keyed_rows(_one_target(entries), 1).select("key", "copies"))
    n_keys = settled.count()
    # The names' few bytes are read as one split, and are much work.
    sources = spread(settled, n_keys)
    common = quoted_list(common_grams(sources))
    postings = f"{name}_postings_{uuid.uuid4().hex[:12]}"
    buckets = _buckets(spark, n_keys)
    _save(_postings(sources, common), postings, "probe", buckets=buckets)
    spark.sql(f"CREATE OR REPLACE VIEW {name}_postings AS SELECT * FROM {postings}")
    kept = {"common": common, "least": least_threshold, "most": most_answers, "postings": postings, "buckets": buckets}
    _publish(spark, name, entries, tfidf.count_terms(sources), kept)
    return MatchIndex(spark, name)


def apply_changes(index: MatchIndex, diff: DataFrame) -> None:
    """Bring the index up to date with a dictionary changed by diff (src, target, change), as apply_diff changes it.

    Deleted pairs go with all their copies, inserted ones come once; other changes do not touch the index. Names that the
    postings know already, even from before, are not added again.
    """
    spark, facts = index.spark, index.table("facts").first()
    changed = settle(diff.filter(F.col("change").isin("insert", "delete")).select("src", "target", "change"))
    sources = changed.select("src").distinct()
    old = index.table("entries")
    before = settle(_matching(old, sources, ["src"], "left_semi"))
    left = _matching(before, changed.filter("change = 'delete'").select("src", "target"), ["src", "target"], "left_anti")
    added = changed.filter("change = 'insert'").select("src", "target", F.lit(1).cast("bigint").alias("n"))
    after = settle(left.unionByName(added).groupBy("src", "target").agg(F.sum("n").alias("n")))
    entries = _matching(old, sources, ["src"], "left_anti").unionByName(after)

    def copies(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(text.normalize_name(F.col("src")).alias("key"), (F.col("n") * sign).alias("copies"))

    moved = copies(after, 1).unionByName(copies(before, -1)).groupBy("key").agg(F.sum("copies").alias("copies"))
    both = index.table("terms").unionByName(tfidf.count_terms(moved.filter("copies <> 0")))
    terms = both.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).filter("tf > 0")
    keys = copies(after, 1).select("key").distinct()
    posted = index.table("postings").filter("probe LIKE 'x:%'").select("key").distinct()
    new, kept = settle(keys.join(posted, "key", "left_anti")), facts.asDict()
    n_new = new.count()
    postings = _postings(spread(new, n_new), facts["common"])
    buckets = _buckets(spark, posted.count() + n_new)
    if buckets > _OUTGROWN * facts["buckets"]:
        # Written anew, as a table's buckets stay as they are.
        kept |= {"buckets": buckets, "postings": f"{index.name}_postings_{uuid.uuid4().hex[:12]}"}
        _save(index.table("postings").unionByName(postings), kept["postings"], "probe", buckets=buckets)
        spark.sql(f"CREATE OR REPLACE VIEW {index.name}_postings AS SELECT * FROM {kept['postings']}")
    else:
        _save(postings, facts["postings"], "probe", "append", facts["buckets"])
    _publish(spark, index.name, entries, terms, kept)


def _matching(rows: DataFrame, others: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join in which missing values are values like any other."""
    renamed = others.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(renamed, same, how)


def _best_pairs(asked: list[str], names: list[Row], ratio: float, most_pairs: int) -> list[tuple[str, str]]:
    """The best pairs of the names asked for with a block of source names (key, first), as characters.best_of gives them."""
    right, found = [n["key"] for n in names], []
    for start in range(0, len(asked), characters.LEFT_NAMES):
        left = asked[start : start + characters.LEFT_NAMES]
        at = characters.best_of(left, right, [n["first"] or "" for n in names], ratio, most_pairs)
        found += [(left[i], right[j]) for i, j in zip(*at, strict=True)]
    return found


# Declared nondeterministic so that the blocks are compared once, not for every use of what they give.
_PAIRS = ArrayType(StructType([StructField("a", StringType()), StructField("b", StringType())]))
best_pairs = udf(_best_pairs, _PAIRS, useArrow=False).asNondeterministic()


def _body(index: str, common: str, least: float, most: int, parts: int) -> str:
    """The table function's query; its parameters are input_fields, top_n and min_threshold.

    Pairs are compared in so many tasks: few bytes may be much work, which the size of a shuffle does not tell. The planner
    takes the array for one row and knows neither how many names it holds nor how many probes they have, also while it runs,
    so joins with what is made of them are told to merge: broadcast, it would have to fit the driver.
    """
    share = f"(if(has_terms, {text.BASIC_SHARE}D, 1D) * {text.SEQUENCE_WEIGHT}D)"
    contains = "contains(a, b) OR contains(b, a)"
    probed = [
        probes.tagged("x", "array(key)"),
        probes.tagged("g", probes.one_gram("key", f"({probes.signature_grams('key', common)})")),
        probes.tagged("h", probes.all_grams("key")),
        probes.tagged("w", f"if(least > {share}, {probes.reachable_words('words', 'entries', share, 'least')}, words)"),
    ]
    total = "(length(a) + length(b))"
    known = (
        "CASE WHEN length(b) >= 200 THEN NULL WHEN exact = 1 THEN 1D "
        f"WHEN inside = 1 THEN 2 * least(length(a), length(b)) / {total} END"
    )
    highest = f"if({total} > 0, 2 * in_common / {total}, 1D)"

    def combined(sequence: str) -> str:
        basic = (
            f"(exact * {text.EXACT_WEIGHT}D + inside * {text.SUBSTRING_WEIGHT}D + {sequence} * {text.SEQUENCE_WEIGHT}D"
            f" + overlap * {text.OVERLAP_WEIGHT}D)"
        )
        return f"if(has_terms, {basic} * {text.BASIC_SHARE}D + tfidf * {text.TFIDF_SHARE}D, {basic})"

    shared = "size(array_intersect(words_a, words_b))"
    union = f"(size(words_a) + size(words_b) - {shared})"

    def partly(pairs: str) -> str:
        return f"""
      SELECT *, CAST(a = b AS DOUBLE) AS exact, CAST({contains} AS DOUBLE) AS inside,
             if({union} > 0, {shared} / {union}, 0D) AS overlap, {tfidf.dot_sql('vec_a', 'vec_b')} AS tfidf
      FROM (
        SELECT /*+ MERGE(f, m) */ a, b, f.n, f.least, f.has_terms, rows, f.words AS words_a, m.words AS words_b, f.vec AS vec_a, m.vec AS vec_b
        FROM {pairs} JOIN featured f ON a = f.key JOIN {index}_names m ON b = m.key
      )"""

    rounded = ", ".join(
        f"bround({part}, 4) AS {name}"
        for part, name in (
            ("combined", "combined_score"), ("exact", "exact_score"), ("inside", "substring_score"),
            ("sequence", "sequence_score"), ("overlap", "word_overlap"), ("tfidf", "tfidf_score"),
        )
    )
    n_blocks = f"(SELECT CAST(greatest(ceil(count(1) / {characters.RIGHT_NAMES}), 1) AS BIGINT) FROM {index}_names)"
    limits = f"the index answers up to {most} matches from a threshold of {least} on"
    return f"""
    WITH asked AS (
      SELECT posexplode(input_fields) AS (pos, input_field)
      WHERE if(top_n > {most} OR min_threshold < {least}D, raise_error('{limits}'), true)
    ),
    keyed AS (SELECT pos, input_field, {text.normalize_sql('input_field')} AS key FROM asked),
    own AS (SELECT key, {text.tokens_sql('key')} AS toks FROM (SELECT DISTINCT key FROM keyed)),
    counted AS (
      SELECT key, term, count(1) AS tf, max(idf) AS idf
      FROM (SELECT key, explode(concat({text.word_ngrams_sql('toks')}, array(''))) AS term FROM own)
      LEFT JOIN {index}_vocabulary USING (term) GROUP BY key, term
    ),
    weighed AS (
      SELECT key, sort_array(collect_list(if(idf IS NOT NULL, struct(term, idf, tf * idf AS weight), NULL))) AS raw
      FROM counted GROUP BY key
    ),
    unit AS (
      SELECT key, transform(raw, e -> struct(e.term AS term, e.idf AS idf, e.weight / size AS weight)) AS entries
      FROM (SELECT key, raw, sqrt(aggregate(raw, 0D, (total, e) -> total + e.weight * e.weight)) AS size FROM weighed)
    ),
    featured AS (
      SELECT /*+ BROADCAST(facts) */ key, top_n AS n, CAST(min_threshold AS DOUBLE) AS least, entries,
             {tfidf.vector_sql('entries')} AS vec,
             {probes.rarity_order_sql("filter(array_distinct(split(key, ' ')), w -> w <> '')", 'entries')} AS words,
             has_terms, has_empty, first_keys, {share} AS share
      FROM unit CROSS JOIN (SELECT has_terms, has_empty, first_keys FROM {index}_facts) facts
    ),
    probed AS (
      SELECT key AS a, explode(array_distinct(concat({', '.join(probed)}))) AS probe
      FROM featured WHERE key <> ''
    ),
    met AS (
      SELECT /*+ MERGE(probed, p) */ a, p.key AS b
      FROM probed JOIN {index}_postings p USING (probe)
      WHERE CASE substring(probe, 1, 1) WHEN 'g' THEN contains(p.key, a) WHEN 'h' THEN contains(a, p.key) ELSE true END
      UNION ALL SELECT key, b FROM (SELECT key, explode(first_keys) AS b FROM featured WHERE key = '') WHERE b <> ''
      UNION ALL SELECT key, '' FROM featured WHERE has_empty
    ),
    once AS (SELECT /*+ REPARTITION({parts}, a, b) */ DISTINCT a, b FROM met),
    sure AS ({partly('once')}),
    done AS (
      SELECT a FROM sure WHERE {combined('0D')} >= if(has_terms, {text.BASIC_SHARE}D, 1D) * {text.SEQUENCE_WEIGHT}D
      GROUP BY a HAVING count(1) >= max(n)
    ),
    open AS (
      SELECT /*+ MERGE(done) */ key, least / share AS ratio, n, (row_number() OVER (ORDER BY key) - 1) DIV {_RUN_NAMES} AS run
      FROM featured LEFT ANTI JOIN done ON key = a WHERE key <> '' AND least / share < 1 - 1e-9D
    ),
    runs AS (
      SELECT keys, ratio, n, explode(sequence(0, {n_blocks} - 1)) AS block
      FROM (SELECT collect_list(key) AS keys, max(ratio) AS ratio, max(n) AS n FROM open GROUP BY run)
    ),
    blocks AS (
      SELECT block, collect_list(struct(key, first)) AS names
      FROM (
        SELECT /*+ REPARTITION({parts}, block) */ key, element_at(rows, 1).src AS first, pmod(xxhash64(key), {n_blocks}) AS block
        FROM {index}_names WHERE key <> ''
      ) GROUP BY block
    ),
    compared AS (
      SELECT /*+ MERGE(runs, blocks) */ {index}_best_pairs(keys, names, ratio, n) AS found FROM runs JOIN blocks USING (block)
    ),
    alike AS (SELECT inline(found) AS (a, b) FROM compared),
    partly AS (SELECT * FROM sure UNION ALL {partly('alike')}),
    bounded AS (SELECT *, {known} AS known, {text.shared_characters_sql('a', 'b')} AS in_common FROM partly),
    hopeful AS (SELECT * FROM bounded WHERE {combined(f'coalesce(known, {highest})')} >= least - 1e-9D),
    sequenced AS (
      SELECT *, coalesce(known, {index}_sequence_ratio(if(known IS NULL, a, NULL), if(known IS NULL, b, NULL))) AS sequence
      FROM hopeful
    ),
    scored AS (SELECT *, {combined('sequence')} AS combined FROM sequenced),
    placed AS (
      SELECT *, row_number() OVER (
               PARTITION BY a ORDER BY round(combined, 10) DESC, element_at(rows, 1).src ASC NULLS LAST) AS place
      FROM scored WHERE combined >= least
    ),
    rowwise AS (SELECT * EXCEPT (rows), inline(rows) FROM placed WHERE place <= n),
    repeated AS (SELECT *, explode(sequence(1, CAST(least(copies, n) AS INT))) AS copy FROM rowwise),
    ranked AS (
      SELECT *, CAST(row_number() OVER (
               PARTITION BY a ORDER BY round(combined, 10) DESC, src ASC NULLS LAST, copy) AS INT) AS match_rank
      FROM repeated
    ),
    answers AS (
      SELECT a, n, src AS src_field, coalesce(target, '{text.UNMAPPED}') AS target_field, {rounded}, match_rank
      FROM ranked
    )
    SELECT /*+ MERGE(keyed, answers) */ input_field, src_field, target_field, combined_score, exact_score, substring_score, sequence_score,
           word_overlap, tfidf_score, match_rank
    FROM keyed JOIN answers ON key = a WHERE match_rank <= answers.n
    """


def create_match_function(index: MatchIndex, function: str = "field_match") -> None:
    """For SQL users: SELECT * FROM field_match(array('Order-Date', ...) [, top_n [, min_threshold]]).

    Names come as an array, also as a scalar subquery like (SELECT collect_list(name) FROM t); defaults are 3 and 0.1.
    A call reads the index as it is then. The function lasts as long as the session.
    """
    facts = index.table("facts").first()
    index.spark.udf.register(f"{index.name}_sequence_ratio", sequence_ratio)
    index.spark.udf.register(f"{index.name}_best_pairs", best_pairs)
    index.spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {function}(
              input_fields ARRAY<STRING>, top_n INT DEFAULT 3, min_threshold DOUBLE DEFAULT {facts['least']}D)
            RETURNS TABLE (input_field STRING, src_field STRING, target_field STRING, combined_score DOUBLE,
              exact_score DOUBLE, substring_score DOUBLE, sequence_score DOUBLE, word_overlap DOUBLE,
              tfidf_score DOUBLE, match_rank INT)
            RETURN {_body(index.name, facts['common'], facts['least'], facts['most'], _shuffled_into(index.spark))}"""
    )
