"""TF-IDF over word 1..3-grams as a relation: terms, weights and cosines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from schemalign.functions import text
from schemalign.operators import skew
from schemalign.operators.settle import settle

MAX_TERMS = 1000


# Up to so many words are frequent enough to be looked for in n-grams by a list; with more, all n-grams are counted.
MOST_FREQUENT = 5_000


def _occurrences(grams: str) -> Column:
    """Every occurrence adds to tf, the first one in a name also to df, so one map-side combined sum gives both."""
    return F.expr(
        f"concat(transform({grams}, g -> struct(g AS term, copies AS tf, 0L AS df)), "
        f"transform(array_distinct({grams}), g -> struct(g AS term, 0L AS tf, copies AS df)))"
    )


def _summed(rows: DataFrame, grams: str) -> DataFrame:
    inlined = rows.select(F.inline(_occurrences(grams)))
    return inlined.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def count_terms(keys: DataFrame) -> DataFrame:
    """(key, copies) -> (term, tf, df). Copies of a name count as documents of their own."""
    rows = keys.select("copies", text.tokens(F.col("key")).alias("toks"))
    return _summed(rows.select("copies", text.word_ngrams("toks").alias("grams")), "grams")


def with_idf(terms: DataFrame, n_docs: Column) -> DataFrame:
    return terms.withColumn("n_docs", n_docs).withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)


def fit_terms(keys: DataFrame) -> DataFrame:
    """(key, copies) -> (term, tf, df, n_docs, idf)."""
    return with_idf(count_terms(keys), keys.agg(F.sum("copies").alias("n_docs")).scalar())


def fit_vocabulary(keys: DataFrame, size: int | None = None) -> DataFrame:
    """The most frequent terms of (key, copies), as cap_vocabulary(fit_terms(keys)) gives them, in one scan of the names.

    No n-gram is more frequent than its words. Words are counted first; the count of the size-th bounds what can still be
    chosen, so only n-grams made of words that reach it are counted. Tokens are written once for the two counts.
    """
    size = MAX_TERMS if size is None else size
    seen = Observation()
    rows = keys.select("copies", text.tokens(F.col("key")).alias("toks"))
    rows = settle(rows.observe(seen, F.coalesce(F.sum("copies"), F.lit(0)).alias("n_docs")))
    words = settle(_summed(rows, "toks"))
    chosen = cap_vocabulary(words, size).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("least")).first()
    least = chosen["least"] if chosen["n"] == size else 0
    words = words.filter(F.col("tf") >= least)
    frequent = [r["term"] for r in words.select("term").limit(MOST_FREQUENT + 1).collect()]
    if len(frequent) <= MOST_FREQUENT:
        kept = F.transform("toks", lambda w: F.when(w.isin(frequent), w)) if frequent else F.array().cast("array<string>")
        rows = rows.select("copies", kept.alias("toks"))
    rows = rows.select("copies", F.expr(text.known_ngrams_sql("toks", (2, 3))).alias("grams"))
    grams = _summed(rows, "grams").filter(F.col("tf") >= least)
    return with_idf(cap_vocabulary(words.unionByName(grams), size), F.lit(seen.get["n_docs"]).cast("bigint"))


def cap_vocabulary(terms: DataFrame, size: int = MAX_TERMS) -> DataFrame:
    """The most frequent terms; equal counts go by term."""
    return terms.orderBy(F.col("tf").desc(), F.col("term")).limit(size)


def weigh(keys: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, ...) -> (key, entries): the key's vocabulary terms with idf and unit-length weight, sorted by term.

    The vocabulary never exceeds MAX_TERMS rows, so it is broadcast; keys arrive partitioned by key, so the two
    groupings need no further shuffle. The empty term keeps names without any vocabulary term.
    """
    grams = F.concat(text.word_ngrams("toks"), F.array(F.lit("")))
    counted = (
        keys.select("key", text.tokens(F.col("key")).alias("toks"))
        .select("key", F.explode(grams).alias("term"))
        .join(F.broadcast(vocabulary.select("term", "idf")), "term", "left")
        .groupBy("key", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.max("idf").alias("idf"))
    )
    raw = counted.groupBy("key").agg(
        F.sort_array(
            F.collect_list(
                F.when(F.col("idf").isNotNull(), F.struct("term", "idf", (F.col("tf") * F.col("idf")).alias("weight")))
            )
        ).alias("raw")
    )
    length = F.expr("sqrt(aggregate(raw, 0D, (total, e) -> total + e.weight * e.weight))")
    unit = F.expr("transform(raw, e -> struct(e.term AS term, e.idf AS idf, e.weight / length AS weight))")
    return raw.withColumn("length", length).select("key", unit.alias("entries"))


def vector(entries: str) -> Column:
    return F.expr(vector_sql(entries))


def vector_sql(entries: str) -> str:
    return f"map_from_entries(transform({entries}, e -> struct(e.term, e.weight)))"


def dot(left: str, right: str) -> Column:
    """Inner product of two term -> weight maps."""
    return F.expr(dot_sql(left, right))


def dot_sql(left: str, right: str) -> str:
    shared = f"array_intersect(map_keys({left}), map_keys({right}))"
    return f"aggregate({shared}, 0D, (total, term) -> total + {left}[term] * {right}[term])"


def rarest_first(entries: str) -> Column:
    """Entries in one order shared by all names: highest idf first, then by term."""
    return F.expr(f"transform(array_sort(transform({entries}, e -> struct(-e.idf AS rank, e.term AS term, e AS e))), r -> r.e)")


def sparse_cosine(
    queries: DataFrame, documents: DataFrame, vocabulary: DataFrame, min_cosine: float, rows_per_task: int = 200_000
) -> DataFrame:
    """(key), (key) -> (input_key, src_key, cosine) for the pairs with cosine >= min_cosine > 0.

    A pair meets at its rarest shared term. All its shared terms lie from there on, so its cosine is at most the
    length of either vector's tail from that term: terms whose tail is shorter than min_cosine, which are the
    common ones, need not be joined at all.
    """
    if min_cosine <= 0:
        raise ValueError("min_cosine must be positive")
    least = min_cosine - 1e-9

    def vectors(keys: DataFrame, name: str) -> DataFrame:
        weighed = weigh(keys, vocabulary).filter(F.size("entries") > 0)
        ordered = F.transform(rarest_first("entries"), lambda e: F.struct(F.xxhash64(e["term"]).alias("term"), e["weight"].alias("weight")))
        return settle(weighed.select(F.monotonically_increasing_id().alias(name), F.col("key").alias(f"{name}_key"), ordered.alias(f"{name}_vector")))

    def postings(side: DataFrame, name: str) -> DataFrame:
        vec = f"{name}_vector"
        tail = f"sqrt(aggregate(slice({vec}, i + 1, size({vec})), 0D, (total, x) -> total + x.weight * x.weight))"
        met_at = f"transform(filter({vec}, (e, i) -> {tail} >= {least}D), e -> e.term)"
        return side.select(name, F.explode(F.expr(met_at)).alias("term"))

    inputs, known = vectors(queries, "input"), vectors(documents, "src")
    # Postings are two numbers; what a pair is made of joins once for each pair.
    met = skew.salted_grid_join(postings(inputs, "input"), postings(known, "src"), "term", rows_per_task)
    pairs = settle(met.select("input", "src").distinct())
    beside = _attached(_attached(pairs, inputs, "input"), known, "src")
    return beside.select("input_key", "src_key", _inner("input_vector", "src_vector").alias("cosine")).filter(F.col("cosine") >= least)


def _attached(pairs: DataFrame, side: DataFrame, name: str) -> DataFrame:
    """What belongs to an id: sent while it is little, by a join otherwise, in which ids of very many pairs are split."""
    size = F.octet_length(f"{name}_key") + 16 * F.size(f"{name}_vector") + 32
    if (side.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0) <= skew.BROADCAST_BYTES:
        return pairs.join(F.broadcast(side), name)
    counts = settle(pairs.groupBy(name).agg(F.count(F.lit(1)).alias("rows")))
    return skew.by_counts(pairs, side, [name], "inner", counts)


def _inner(left: str, right: str) -> Column:
    """Inner product of two lists of (term, weight)."""
    other = f"aggregate({right}, 0D, (held, x) -> if(x.term = e.term, x.weight, held))"
    return F.expr(f"aggregate({left}, 0D, (total, e) -> total + e.weight * {other})")
