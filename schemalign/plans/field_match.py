"""The matcher: for every input name the best source names of the dictionary and their targets.

Inputs and dictionary are reduced to distinct normal forms, pairs that can reach the threshold meet by one equi-join on
probes (see operators.probes), cheap exact parts of the score and an upper bound of the sequence ratio drop pairs that
cannot be among an input's best, and only the rest is handed to the sequence UDF. Of pairs that share characters only, an
input's best are found by counts of characters, block by block (see operators.characters). No step drops a pair that belongs to
the answer; tests compare with all pairs scored one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemalign.functions import text
from schemalign.functions.sequence import sequence_ratio
from schemalign.operators import lexicon as lx
from schemalign.operators import characters, probes, skew, tfidf
from schemalign.operators.settle import settle

SCORES = ("combined_score", "exact_score", "substring_score", "sequence_score", "word_overlap", "tfidf_score")

# Up to this many distinct source names (and 100,000 characters of them) the index is broadcast: at most about a
# million short rows.
BROADCAST_KEYS = 5_000

# Up to this many distinct inputs (and 5 million characters of them) their answers are broadcast.
BROADCAST_ANSWERS = 100_000

# Distinct names of one task; more tasks than MOST_TASKS are not made.
KEYS_PER_TASK = 5_000
MOST_TASKS = 20_000

# Scores closer than this count as equal when ranking: sums of doubles differ in the last bits.
_RANK_DIGITS = 10
_SLACK = 1e-9

# From this length on the sequence matcher may ignore very frequent characters of its second argument.
_POPULAR_FROM = 200


def field_match(
    inputs: DataFrame,
    dictionary: DataFrame,
    top_n: int = 3,
    min_threshold: float = 0.1,
    input_col: str = "input_field",
    rows_per_task: int = skew.ROWS_PER_TASK,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Up to top_n matches per input row, best first, with combined score >= min_threshold.

    inputs keeps all its columns; repeated names are answered on every row but scored once. The dictionary is
    (src, target). The distinct names of both sides are settled first (see operators.settle), so calling this runs jobs.
    """
    keyed = inputs.withColumn("_key", text.normalize_name(F.col(input_col)))
    names = settle(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("rows")))
    asked = names.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_key")), F.lit(0)).alias("chars"),
        F.coalesce(F.bool_or(F.col("_key") == ""), F.lit(False)).alias("has_empty"),
    ).first()
    keys = spread(names.select(F.col("_key").alias("key")), asked["n"])
    first_names = 2 * top_n if asked["has_empty"] or min_threshold <= 0 else 0
    answers = match_keys(
        keys, asked["n"], dictionary, top_n, min_threshold, rows_per_task, broadcast_keys, first_names
    )
    answers = answers.withColumnRenamed("key", "_key")
    if asked["n"] * top_n <= BROADCAST_ANSWERS and asked["chars"] <= 5_000_000 and broadcast_keys:
        joined = keyed.join(F.broadcast(answers), "_key")
    else:
        joined = skew.salted_lookup(keyed, answers, ["_key"], "inner", rows_per_task, counts=names)
    return joined.select(*inputs.columns, F.inline("matches"))


def field_match_names(spark: SparkSession, names: list[str], dictionary: DataFrame, top_n: int = 3,
                      min_threshold: float = 0.1) -> DataFrame:
    """The call form for one list of names: positions kept, result columns only."""
    listed = spark.createDataFrame([(names,)], "names array<string>").select(
        F.posexplode("names").alias("pos", "input_field")
    )
    return field_match(listed, dictionary, top_n, min_threshold).orderBy("pos", "match_rank").drop("pos")


def spread(keyed: DataFrame, n_keys: int) -> DataFrame:
    """Distinct keys over as many tasks as their scoring is worth; their files alone would make few."""
    return keyed.repartition(min(max(math.ceil(n_keys / KEYS_PER_TASK), 1), MOST_TASKS), "key")


def match_keys(
    keys: DataFrame,
    n_keys: int,
    dictionary: DataFrame,
    top_n: int,
    min_threshold: float,
    rows_per_task: int,
    broadcast_keys: int,
    first_names: int,
) -> DataFrame:
    """(key) distinct normal forms -> (key, matches): an array of at most top_n result structs, only where any."""
    sources = settle(lx.lexicon(dictionary, top_n))
    facts = lx.inspect(sources, first_names)
    # Without any term in the dictionary the basic score counts in full.
    share = (text.BASIC_SHARE if facts.has_terms else 1.0) * text.SEQUENCE_WEIGHT
    small = facts.fits_broadcast(broadcast_keys)
    vocabulary = tfidf.cap_vocabulary(tfidf.fit_terms(sources.select("key", "copies")))
    common = [] if small else common_grams(sources)

    def prepared(weighed: DataFrame) -> DataFrame:
        return weighed.withColumn("unique", text.word_set(F.col("key"))).select(
            *weighed.columns, probes.rarity_order("unique", "entries").alias("words"), tfidf.vector("entries").alias("vec"),
            F.expr(probes.signature_grams("key", quoted_list(common))).alias("grams"),
        )

    def probes_of(indexed: bool) -> Column:
        words = "words"
        if min_threshold > share:
            words = probes.reachable_words(words, "entries", share, min_threshold)
        inside, around = probes.all_grams("key", lengths[indexed]), probes.one_gram("key", "grams")
        tagged = [
            probes.tagged("x", "array(key)"),
            probes.tagged("g", inside if indexed else around),
            probes.tagged("h", around if indexed else inside),
            probes.tagged("w", words),
        ]
        every = F.concat(F.expr(f"concat({', '.join(tagged)})"), _trivial_probes(facts, share, min_threshold, indexed))
        return F.explode(every).alias("probe")

    features = ("words", "vec")
    left = prepared(tfidf.weigh(keys, vocabulary))
    if not small:
        left = spread(settle(left), n_keys)
    known = settle(prepared(sources.select("key", "rows").join(tfidf.weigh(sources.select("key"), vocabulary), "key")))
    # What the grams of a side are for: the lengths of the other side's signatures.
    lengths = {False: _signature_lengths(sources), True: probes.GRAM_LENGTHS if small else _signature_lengths(left)}
    if not small:
        known = spread(known, facts.keys)

    def side(df: DataFrame, name: str, *columns: str | Column) -> DataFrame:
        return df.select(F.col("key").alias(name), *[F.col(f).alias(f"{f}_{name}") for f in features], *columns)

    if small:
        # The index proper is (probe, b); what else is known of b is looked up for pairs that meet.
        met = side(left, "a", probes_of(indexed=False)).join(
            F.broadcast(known.select(F.col("key").alias("b"), probes_of(indexed=True))), "probe"
        )
        met = met.filter(_may_count_here()).join(F.broadcast(side(known, "b", "rows")), "b")
    else:
        met = skew.salted_grid_join(
            side(left, "a", probes_of(indexed=False)), side(known, "b", "rows", probes_of(indexed=True)),
            "probe", rows_per_task,
        )
    pairs = met.filter(_counts_here()).select(
        "a", "b", "rows",
        text.exact_score(F.col("a"), F.col("b")).alias("exact"),
        text.substring_score(F.col("a"), F.col("b")).alias("inside"),
        text.overlap_of_sets(F.col("words_a"), F.col("words_b")).alias("overlap"),
        tfidf.dot("vec_a", "vec_b").alias("tfidf"),
    )
    # The sequence ratio a pair needs when it has nothing else to offer; none can have it from 1 on.
    ratio = max(min_threshold, 1e-6) / share
    if ratio < 1 - _SLACK:
        # With top_n pairs above what characters alone can give, an input needs no such pair.
        pairs = settle(pairs)
        sure = _combined(F.lit(0.0), facts.has_terms) >= share
        done = pairs.groupBy(F.col("a").alias("key")).agg(F.count_if(sure).alias("n")).filter(F.col("n") >= top_n)
        open_keys = settle(keys.join(done.select("key"), "key", "left_anti"))
        firsts = known.select("key", F.element_at("rows", 1)["src"].alias("first"))
        alike = settle(characters.best_pairs(open_keys, firsts, ratio, top_n))
        rows = known.select(F.col("key").alias("b"), "rows")
        alike = alike.join(F.broadcast(rows), "b") if small else skew.salted_lookup(alike, rows, ["b"], "inner", rows_per_task)
        nothing = {name: F.lit(0.0) for name in ("exact", "inside", "overlap", "tfidf")}
        pairs = pairs.unionByName(alike.withColumns(nothing))
    hopeful = _can_be_among_best(pairs, facts.has_terms, share, top_n, min_threshold, math.ceil(facts.keys / rows_per_task))
    return _ranked(_scored(hopeful, facts.has_terms, min_threshold), top_n)


def _trivial_probes(facts: lx.LexiconFacts, share: float, min_threshold: float, indexed: bool) -> Column:
    """Probes for pairs that need no index: an empty name on either side, and nothing in common at all.

    An empty input scores the same with every source name, so only the first top_n of them can be its answer. For a
    threshold of 0, an input with fewer than top_n better pairs is filled up from the first 2 * top_n source names.
    """
    key = F.col("key")
    first = key.isin(facts.first_keys) & (key != "")
    given = {"e": first if indexed else key == ""}
    if facts.has_empty and min_threshold <= share:
        given["b"] = key == "" if indexed else key != ""
    if min_threshold <= 0:
        given["z"] = first if indexed else key != ""
    return F.array_compact(F.array(*[F.when(holds, f"{kind}:") for kind, holds in given.items()]))


def common_grams(sources: DataFrame, limit: int = 512, at_least: int = 64) -> list[str]:
    """The grams most source names have: at most `limit` strings, kept out of the signatures."""
    grams = sources.select(F.explode(F.expr(probes.all_grams("key"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names")).filter(F.col("names") >= at_least)
    return [row["gram"] for row in counts.orderBy(F.col("names").desc(), "gram").limit(limit).collect()]


def _signature_lengths(side: DataFrame) -> list[int]:
    """The gram lengths that the signatures of some names have: at most as many as there are."""
    found = side.select(F.expr(probes.signature_length("key")).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found if r["n"])


def quoted_list(values: list[str]) -> str:
    """Normalised names hold word characters and blanks only, so quoting them needs no escapes."""
    return ", ".join(f"'{v}'" for v in values)


def _may_count_here() -> Column:
    """The part of _counts_here that needs the two names only."""
    return F.expr(
        """
        CASE substring(probe, 1, 1)
          WHEN 'g' THEN a <> b AND contains(b, a)
          WHEN 'h' THEN a <> b AND contains(a, b)
          WHEN 'x' THEN true
          ELSE a <> b
        END"""
    )


def _counts_here() -> Column:
    """Whether a pair met at this probe is to be kept here: every pair is kept at exactly one probe."""
    here = F.expr(
        """
        CASE substring(probe, 1, 1)
          WHEN 'x' THEN true
          WHEN 'g' THEN a <> b AND contains(b, a)
          WHEN 'h' THEN a <> b AND contains(a, b)
          WHEN 'w' THEN probe = concat('w:', get(array_intersect(words_a, words_b), 0))
                        AND NOT contains(a, b) AND NOT contains(b, a)
          WHEN 'e' THEN true
          WHEN 'b' THEN true
        END"""
    )
    return F.coalesce(here, text.shared_characters("a", "b") == 0)


def _combined(sequence: Column, fitted: bool) -> Column:
    basic = text.basic_score(F.col("exact"), F.col("inside"), sequence, F.col("overlap"))
    return text.combined_score(basic, F.col("tfidf"), F.lit(fitted))


def _can_be_among_best(
    pairs: DataFrame, fitted: bool, share: float, top_n: int, min_threshold: float, parts: int
) -> DataFrame:
    """Drop pairs whose best possible score is under the threshold or under top_n sure scores of the same input.

    An input's pairs are compared within `parts` parts of them, so that one input met by a whole large dictionary is
    no single task; a part's own top_n sure scores are never above the input's, so nothing is lost.
    """
    a, b = F.col("a"), F.col("b")
    total = F.length(a) + F.length(b)
    known = F.when(
        F.length(b) < _POPULAR_FROM,
        F.when(F.col("exact") == 1, F.lit(1.0)).when(F.col("inside") == 1, 2 * F.least(F.length(a), F.length(b)) / total),
    )
    most = F.when(total > 0, 2 * text.shared_characters("a", "b") / total).otherwise(F.lit(1.0))

    part = [] if parts == 1 else [F.pmod(F.xxhash64("b"), F.lit(parts))]
    best_first = Window.partitionBy("a", *part).orderBy(F.col("sure").desc())
    so_far = best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = (
        pairs.withColumn("known", known)
        .withColumn("sure", _combined(F.coalesce("known", F.lit(0.0)), fitted))
        .withColumn("most", _combined(F.coalesce("known", most), fitted))
        .filter(F.col("most") >= min_threshold - _SLACK)
    )
    nth = F.nth_value("sure", top_n).over(so_far)
    return (
        bounded.withColumn("nth", nth)
        .filter(F.col("nth").isNull() | (F.col("most") >= F.col("nth") - _SLACK))
        .drop("nth", "sure", "most")
    )


def _scored(pairs: DataFrame, fitted: bool, min_threshold: float) -> DataFrame:
    unknown = lambda side: F.when(F.col("known").isNull(), F.col(side))
    sequence = F.coalesce("known", sequence_ratio(unknown("a"), unknown("b")))
    return (
        pairs.withColumn("sequence", sequence)
        .withColumn("combined", _combined(F.col("sequence"), fitted))
        .filter(F.col("combined") >= min_threshold)
    )


def _ranked(scored: DataFrame, top_n: int) -> DataFrame:
    """(key, matches): best first, equal scores in source name order, repeated source names repeated."""
    score = F.round("combined", _RANK_DIGITS).desc()
    by_key = Window.partitionBy("a").orderBy(score, F.element_at("rows", 1)["src"].asc_nulls_last())
    by_row = Window.partitionBy("a").orderBy(score, F.col("src").asc_nulls_last(), "copy")
    best = scored.withColumn("place", F.row_number().over(by_key)).filter(F.col("place") <= top_n)
    rows = (
        best.select("a", "combined", "exact", "inside", "sequence", "overlap", "tfidf", F.inline("rows"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(top_n)).cast("int"))))
        .withColumn("match_rank", F.row_number().over(by_row))
        .filter(F.col("match_rank") <= top_n)
    )
    parts = ("combined", "exact", "inside", "sequence", "overlap", "tfidf")
    scores = [F.bround(part, 4).alias(name) for part, name in zip(parts, SCORES, strict=True)]
    result = F.struct(
        "match_rank", F.col("src").alias("src_field"), F.coalesce("target", F.lit(text.UNMAPPED)).alias("target_field"), *scores
    )
    in_order = lambda m: F.struct(
        *[m[name].alias(name) for name in ("src_field", "target_field", *SCORES, "match_rank")]
    )
    return rows.groupBy(F.col("a").alias("key")).agg(
        F.transform(F.sort_array(F.collect_list(result)), in_order).alias("matches")
    )


def match_view(
    spark: SparkSession, inputs: str, dictionary: str, result: str, top_n: int = 3, min_threshold: float = 0.1
) -> None:
    """For SQL users: a temporary view of the matches of a view of names (input_field and any other columns).

    It shows the names and the dictionary as they are now; called again with the same names it shows them anew. A list
    of names comes as a view, e.g. CREATE TEMP VIEW names AS SELECT explode(array('a', 'b')) AS input_field.
    """
    field_match(spark.table(inputs), spark.table(dictionary), top_n, min_threshold).createOrReplaceTempView(result)
