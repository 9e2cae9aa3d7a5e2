"""Join keys under which every pair of names that can reach a score must meet.

Each side turns a name into a set of probes; pairs meet by one equi-join on them. The kinds of meeting are disjoint,
and inside a kind a pair is kept at one probe only, so no de-duplication is needed afterwards:

x  equal normal forms
g  the input lies inside the source name: one gram of the input against all grams of the source name
h  the source name lies inside the input: the reverse
w  a shared word, met at the rarest one
e  an empty input, with the first source names: it scores the same with all of them
b  an empty source name, with every input
z  nothing shared at all, with the first source names (only for a threshold of 0)

Pairs that share nothing but characters are found in operators.characters. The functions take column names or SQL
expressions; those returning strings give SQL expressions for the caller to put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemalign.functions import text

# Gram lengths of the containment index; a name uses the longest one it can fill.
GRAM_LENGTHS = (1, 2, 3, 8)

# Names with more words than this keep all their words as probes.
MANY_WORDS = 64

# Above any idf a dictionary of fewer than 10^40 rows can give.
UNKNOWN_IDF = 99.0

_NONE = "cast(array() AS array<string>)"


def tagged(kind: str, values: str) -> str:
    return f"transform({values}, v -> concat('{kind}:', v))"


def _grams(key: str, n: int) -> str:
    grams = f"array_distinct(transform(sequence(1, length({key}) - {n - 1}), i -> substring({key}, i, {n})))"
    return f"if(length({key}) >= {n}, {grams}, {_NONE})"


def all_grams(key: str, lengths: Sequence[int] = GRAM_LENGTHS) -> str:
    """All grams of these lengths: those of signature_length of the names on the other side."""
    return f"concat({', '.join([_NONE, *(_grams(key, n) for n in lengths)])})"


def signature_length(key: str) -> str:
    """The length of the grams of a key's signature."""
    return f"CASE {' '.join(f'WHEN length({key}) >= {n} THEN {n}' for n in reversed(GRAM_LENGTHS))} END"


def signature_grams(key: str, common: str = "") -> str:
    """The grams one of which is the key's signature: its longest kind, without the common ones if any are left."""
    grams = _grams(key, GRAM_LENGTHS[0])
    for n in GRAM_LENGTHS[1:]:
        grams = f"if(length({key}) >= {n}, {_grams(key, n)}, {grams})"
    if not common:
        return grams
    rare = f"filter({grams}, g -> g NOT IN ({common}))"
    return f"if(size({rare}) > 0, {rare}, {grams})"


def one_gram(key: str, grams: str) -> str:
    """One of the grams, as an array; each key takes one of its own, so that keys with like grams spread out."""
    return f"slice({grams}, 1 + CAST(pmod(xxhash64({key}), greatest(size({grams}), 1)) AS int), 1)"


def rarity_order(words: str, entries: str) -> Column:
    """Words from rare to common: unknown to the vocabulary, then by falling idf, single characters last."""
    return F.expr(rarity_order_sql(words, entries))


def rarity_order_sql(words: str, entries: str) -> str:
    known = f"aggregate({entries}, {UNKNOWN_IDF}D, (idf, e) -> if(e.term = w, e.idf, idf))"
    rank = f"if(length(w) < 2, 0D, -{known})"
    ranked = f"transform({words}, w -> struct({rank} AS rank, w AS word))"
    return f"transform(array_sort({ranked}), r -> r.word)"


def reachable_words(ordered: str, entries: str, share: float | str, threshold: float | str) -> str:
    """The words at which a pair sharing no rarer word can still reach the threshold.

    A pair met at word i of n shares at most the words from i on: its overlap is at most (n-i+1)/n and its cosine at
    most the length of the vector's part made of those words. Nothing else but the sequence ratio, at most 1, adds
    to its score (containment is met elsewhere). Very long names keep all their words. Share and threshold may be SQL.
    """
    share = share if isinstance(share, str) else f"{share}D"
    least = f"({threshold} - 1e-9D)" if isinstance(threshold, str) else f"{threshold - 1e-9}D"
    n = f"size({ordered})"
    rest = f"slice({ordered}, i + 1, greatest({n}, 1))"
    inside = f"forall(split(e.term, ' '), x -> array_contains({rest}, x))"
    squares = f"aggregate({entries}, 0D, (total, e) -> total + if({inside}, e.weight * e.weight, 0D))"
    bound = f"{share} * (1 + ({n} - i) / {n}) + {text.TFIDF_SHARE}D * sqrt({squares})"
    kept = f"filter({ordered}, (w, i) -> {bound} >= {least})"
    return f"if({n} <= {MANY_WORDS}, {kept}, {ordered})"
