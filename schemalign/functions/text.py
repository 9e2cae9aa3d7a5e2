"""Name normalisation, words, n-grams and the built-in similarity measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blend of the similarity measures.
EXACT_WEIGHT = 0.4
SUBSTRING_WEIGHT = 0.2
SEQUENCE_WEIGHT = 0.2
OVERLAP_WEIGHT = 0.2
BASIC_SHARE = 0.7
TFIDF_SHARE = 0.3

# Confidence bands.
HIGH_CONFIDENCE = 0.8
MEDIUM_CONFIDENCE = 0.5

IGNORED = "(Ignored)"
UNMAPPED = "UNMAPPED"


def normalize_name(name: Column) -> Column:
    """Lower case, anything but word characters to blanks, blanks collapsed; NULL becomes ''.

    The class names Unicode letters and digits itself because the regex engine's own word class is ASCII only.
    """
    spaced = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", " ")
    return F.coalesce(F.trim(F.regexp_replace(spaced, r"\s+", " ")), F.lit(""))


def normalize_sql(name: str) -> str:
    """normalize_name as SQL text."""
    spaced = rf"regexp_replace(lower({name}), r'[^\p{{L}}\p{{N}}_\s]', ' ')"
    return rf"coalesce(trim(regexp_replace({spaced}, r'\s+', ' ')), '')"


def words(clean: Column) -> Column:
    """Words of a normalised name, repeats kept."""
    return F.filter(F.split(clean, " "), lambda w: w != "")


def word_set(clean: Column) -> Column:
    return F.array_distinct(words(clean))


def tokens(text: Column) -> Column:
    """Runs of two or more word characters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), r'([\p{{L}}\p{{N}}_]{{2,}})', 1)"


def word_ngrams(toks: str, longest: int = 3) -> Column:
    """All runs of 1..longest consecutive tokens, each joined by a blank.

    toks names a column: an expression would be computed anew for every element of the lambdas.
    """
    return F.expr(word_ngrams_sql(toks, longest))


def word_ngrams_sql(toks: str, longest: int = 3) -> str:

    def of_length(n: int) -> str:
        following = "".join(f", get({toks}, i + {k})" for k in range(1, n))
        return f"transform(slice({toks}, 1, greatest(size({toks}) - {n - 1}, 0)), (w, i) -> concat_ws(' ', w{following}))"

    return f"concat({', '.join([toks, *map(of_length, range(2, longest + 1))])})"


def known_ngrams_sql(toks: str, lengths: tuple[int, ...]) -> str:
    """Runs of these lengths of tokens none of which is NULL, each joined by a blank."""

    def of_length(n: int) -> str:
        run = [f"get({toks}, i + {k})" for k in range(n)]
        joined = f"if({' AND '.join(f'{w} IS NOT NULL' for w in run)}, concat_ws(' ', {', '.join(run)}), NULL)"
        return f"transform(slice({toks}, 1, greatest(size({toks}) - {n - 1}, 0)), (w, i) -> {joined})"

    return f"array_compact(concat({', '.join(map(of_length, lengths))}))"


def exact_score(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def substring_score(a: Column, b: Column) -> Column:
    return (F.contains(a, b) | F.contains(b, a)).cast("double")


def overlap_of_sets(words_a: Column, words_b: Column) -> Column:
    shared = F.size(F.array_intersect(words_a, words_b))
    union = F.size(words_a) + F.size(words_b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two word sets; 0 when both are empty."""
    return overlap_of_sets(word_set(a), word_set(b))


def shared_characters(a: str, b: str) -> Column:
    """Size of the common character multiset of two columns: no alignment of them matches more characters."""
    return F.expr(shared_characters_sql(a, b))


def shared_characters_sql(a: str, b: str) -> str:
    def copies(text: str) -> str:
        return f"length({text}) - length(replace({text}, ch, ''))"

    return (
        f"if(length({a}) = 0, 0, aggregate(array_distinct(transform(sequence(1, length({a})), "
        f"i -> substring({a}, i, 1))), 0, (total, ch) -> total + least({copies(a)}, {copies(b)})))"
    )


def basic_score(exact: Column, substring: Column, sequence: Column, overlap: Column) -> Column:
    return (
        exact * EXACT_WEIGHT
        + substring * SUBSTRING_WEIGHT
        + sequence * SEQUENCE_WEIGHT
        + overlap * OVERLAP_WEIGHT
    )


def combined_score(basic: Column, tfidf: Column, fitted: Column) -> Column:
    """Blend with the TF-IDF cosine; a dictionary without any term leaves the basic score unscaled."""
    return F.when(fitted, basic * BASIC_SHARE + tfidf * TFIDF_SHARE).otherwise(basic)


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= HIGH_CONFIDENCE, "High").when(score >= MEDIUM_CONFIDENCE, "Medium").otherwise("Low")
    )


def table_name(file_name: Column) -> Column:
    """A table name from a file name: last extension off, odd characters to '_', upper case, at most 128."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    safe = F.regexp_replace(stem, "[^a-zA-Z0-9_]", "_")
    led = F.when((safe != "") & ~safe.rlike("^[A-Za-z]"), F.concat(F.lit("T_"), safe)).otherwise(safe)
    return F.substring(F.upper(led), 1, 128)
