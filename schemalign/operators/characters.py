"""Pairs of names that are alike in their characters only: the candidates for a score made of the sequence ratio alone.

Two names of sequence ratio r share at least r(|a|+|b|)/2 characters, counted with repeats, and the shorter has at
least r/(2-r) of the longer one's length. pairs_by_index gives exactly the pairs within these bounds, each once; best_pairs
gives a few of the best for each name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.functions import text
from schemalign.functions.sequence import ratios as sequence_ratios
from schemalign.operators import probes, skew
from schemalign.operators.settle import settle

# Character combinations are built for names up to this length; longer ones are compared by their counts, in blocks.
SHORT_NAME = 64
BLOCK_NAMES = 1024
CHARACTER_GROUPS, PAIR_GROUPS = 128, 256

# Characters of the dictionary that get a place in the order from rare to common; others come first. Only the number of
# candidates depends on it.
ORDERED_CHARACTERS = 2000


def rare_to_common(sources: DataFrame) -> str:
    """The characters of the source names, those in few names first."""
    characters = sources.select(F.explode(F.array_distinct(F.split("key", ""))).alias("ch")).filter("ch <> ''")
    counts = characters.groupBy("ch").agg(F.count(F.lit(1)).alias("names"))
    frequent = counts.orderBy(F.col("names").desc(), "ch").limit(ORDERED_CHARACTERS).collect()
    return "".join(r["ch"] for r in reversed(frequent))


def pairs_by_index(keys: DataFrame, sources: DataFrame, ratio: float, rows_per_task: int) -> DataFrame:
    """(key), (key), both settled -> (a, b) within the bounds.

    Short names meet by an equi-join on character probes of both sides; a pair that meets at several probes is kept at
    one: at its two rarest shared tokens, or at its only shared one. Pairs with a long name come from long_pairs.
    """
    order = rare_to_common(sources)

    def probed(side: DataFrame, name: str, indexed: bool) -> DataFrame:
        short = side.filter(F.length("key").between(1, SHORT_NAME))
        toks = short.select("key", character_tokens("key", order).alias("toks"))
        every = F.expr(character_probes("key", "toks", ratio, indexed, None))
        return toks.select(F.explode(every).alias("probe"), F.col("key").alias(name), F.expr(_prefix("key", "toks", ratio)).alias(f"toks_{name}"))

    met = skew.salted_grid_join(probed(keys, "a", False), probed(sources, "b", True), "probe", rows_per_task)
    similar = F.expr(
        f"least(length(a), length(b)) >= {_length_ratio(ratio)}D * greatest(length(a), length(b)) - 1e-9D"
    )
    shared = F.array_intersect("toks_a", "toks_b")
    rarest = F.concat(F.get(shared, F.lit(0)), F.coalesce(F.get(shared, F.lit(1)), F.lit("")))
    here = F.col("probe") == F.concat(F.lit("q:"), rarest)
    enough = text.shared_characters("a", "b") >= F.expr(needed_characters("a", "b", ratio))
    pairs = met.filter(similar).filter(here).select("a", "b")
    sides = keys.select("key").unionByName(sources.select("key"))
    if (sides.agg(F.max(F.length("key")).alias("n")).first()["n"] or 0) > SHORT_NAME:
        pairs = pairs.unionByName(long_pairs(keys, sources, ratio))
    return pairs.filter(enough)


def _grouped_counts(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, counts of characters, counts of neighbouring pairs) of names, both in groups."""
    sizes = np.array([len(n) for n in names], np.int64)
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(names)), sizes)
    characters = np.zeros((len(names), CHARACTER_GROUPS), np.int32)
    np.add.at(characters, (owner, codes % CHARACTER_GROUPS), 1)
    inner = owner[1:] == owner[:-1]
    mixed = (codes[:-1] * 31 + codes[1:]) % PAIR_GROUPS
    pairs = np.zeros((len(names), PAIR_GROUPS), np.int32)
    np.add.at(pairs, (owner[1:][inner], mixed[inner]), 1)
    return sizes, characters, pairs


def within_counts(left: list[str], right: list[str], ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the pairs of names whose counts allow the sequence ratio; none is lost.

    Names of lengths m and n need r(m + n)/2 characters in common, so as many in groups of them. What is not matched,
    (1 - r)(m + n) characters, cuts the matched ones in no more blocks than one more than that, so at least
    (m + n)(3r/2 - 1) - 1 neighbouring pairs are in common, too.
    """
    (size_a, chars_a, pairs_a), (size_b, chars_b, pairs_b) = _grouped_counts(left), _grouped_counts(right)
    found_a, found_b = [], []
    for k in range(len(left)):
        both = size_a[k] + size_b
        needed = np.maximum(np.ceil(ratio * both / 2 - 1e-9), 1)
        at = np.flatnonzero(2 * np.minimum(size_a[k], size_b) >= ratio * both - 1e-9)
        at = at[np.minimum(chars_a[k], chars_b[at]).sum(axis=1) >= needed[at]]
        at = at[np.minimum(pairs_a[k], pairs_b[at]).sum(axis=1) >= both[at] * (1.5 * ratio - 1) - 1 - 1e-6]
        found_a.append(np.full(len(at), k))
        found_b.append(at)
    return np.concatenate([np.zeros(0, np.int64), *found_a]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *found_b]).astype(np.int64)


def long_pairs(keys: DataFrame, sources: DataFrame, ratio: float, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(key), (key) -> (a, b) that the counts allow, at least one of them longer than SHORT_NAME.

    Names meet by length class, the source names in the neighbouring classes, too; a class is cut in blocks of bounded
    size on either side, and each pair of blocks is compared as one, by counts, so that only pairs within the bounds
    become rows.
    """
    shrink = _length_ratio(ratio)
    size = F.length("key")
    length_class = F.floor(F.log(size) / -math.log(shrink)).cast("int")
    left = settle(keys.filter(size > SHORT_NAME * shrink).select("key", length_class.alias("class")))
    spread = F.explode(F.sequence(length_class - 1, length_class + 1)).alias("class")
    right = settle(sources.filter(size > SHORT_NAME * shrink).select("key", spread))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / block_names).cast("int").alias(name))

    # One row for each class; lengths up to two thousand million make a few dozen.
    parts = F.broadcast(blocks(left, "left_parts").join(blocks(right, "right_parts"), "class"))

    def located(side: DataFrame, own: str, other: str) -> DataFrame:
        placed = side.join(parts, "class").withColumn(own, F.pmod(F.xxhash64("key"), F.col(f"{own}_parts")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))).select("key", "class", "left", "right")

    cell = ("class", "left", "right")

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names_a, names_b = a["key"].tolist(), b["key"].tolist()
        at_a, at_b = within_counts(names_a, names_b, ratio) if names_a and names_b else ([], [])
        found = [(names_a[i], names_b[j]) for i, j in zip(at_a, at_b, strict=True) if max(len(names_a[i]), len(names_b[j])) > SHORT_NAME]
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    met = located(left, "left", "right").groupBy(*cell).cogroup(located(right, "right", "left").groupBy(*cell))
    return met.applyInPandas(compared, "a string, b string")


# Names of either side that are compared as one, and what their features are put together into at most.
LEFT_NAMES, RIGHT_NAMES, FEATURES = 4096, 16384, 512

# Comparisons held at once, pairs whose ratio is computed at once, and tasks that are made at most.
CELLS_AT_ONCE, RATIOS_AT_ONCE, MOST_TASKS = 1 << 21, 1 << 14, 20_000

# Names up to so many characters are compared as sequences of so many kinds of characters before their ratio is computed,
# so many pairs at once.
SEQUENCE_CHARACTERS, SEQUENCE_KINDS, SEQUENCES_AT_ONCE = 256, 64, 1 << 12

# Bounds are computed in single precision.
_SLACK = 1e-6


class _Counted:
    """Names as counts: which copies of which characters, or of which neighbouring pairs, each of them has."""

    def __init__(self, names: list[str]):
        self.sizes = np.array([len(n) for n in names], np.int64)
        codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(names)), self.sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        self.kinds = ((owner, codes), (owner[inner], codes[inner] * 0x110000 + codes[inner + 1]))


def _features(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: tuple[int, int]) -> list[np.ndarray]:
    """Two matrices whose product is in how many values, with repeats, the names agree, or somewhat more.

    A column is the nth copy of a value that both sides have. Where that makes more than FEATURES columns, values are put in
    groups and copies counted in steps, which may agree more often, never less.
    """
    both = np.intersect1d(left[1], right[1])
    some = [(owner[known], value[known]) for owner, value in (left, right) for known in [np.isin(value, both)]]
    for groups in (0, FEATURES // 2, FEATURES // 8):
        if groups:
            width, places = groups, [value % 1_000_003 % groups for _, value in some]
        else:
            width, places = max(len(both), 1), [np.searchsorted(both, value) for _, value in some]
        if width > FEATURES:
            continue
        held = [
            np.bincount(owner * width + place, minlength=n * width).reshape(n, width).astype(np.int32)
            for (owner, _), place, n in zip(some, places, rows, strict=True)
        ]
        ends = np.minimum(*[h.max(axis=0, initial=0) for h in held])
        if ends.sum() <= FEATURES:
            break
    step = max(math.ceil(ends.sum() / FEATURES), 1)
    nth = [(v, n) for v in np.flatnonzero(ends) for n in range(0, ends[v], step)]
    value, least = np.array([v for v, _ in nth], np.int64), np.array([n for _, n in nth], np.int32)
    made = [np.empty((n, len(nth)), np.float32) for n in rows]
    for matrix, h in zip(made, held, strict=True):
        for k in range(0, len(h), 1024):
            matrix[k : k + 1024] = h[k : k + 1024, value] > least
    made[0] *= step
    return made


def _bounds(left: _Counted, right: _Counted, ratio: float):
    """For runs of left names, their places and the highest sequence ratio the counts allow with each right name.

    Names of lengths m and n that have s characters in common have a ratio of 2s / (m + n) at most. What is not matched
    cuts the matched characters in no more blocks than one more than that, so with p neighbouring pairs in common a ratio
    r needs p >= (m + n)(3r/2 - 1) - 1 (see within_counts).
    """
    rows = (len(left.sizes), len(right.sizes))
    (chars_a, chars_b), (pairs_a, pairs_b) = (_features(a, b, rows) for a, b in zip(left.kinds, right.kinds, strict=True))
    step = max(CELLS_AT_ONCE // max(rows[1], 1), 1)
    for start in range(0, rows[0], step):
        at = slice(start, min(start + step, rows[0]))
        total = (left.sizes[at, None] + right.sizes).astype(np.float32)
        most = 2 * (chars_a[at] @ chars_b.T) / total
        # Lengths tell most pairs apart where names differ in them; the pairs of characters are looked at for the rest.
        if (most >= ratio - _SLACK).any():
            np.minimum(most, (pairs_a[at] @ pairs_b.T + 1 + total) / (1.5 * total), out=most)
        yield np.arange(at.start, at.stop), most


class _Sequences:
    """Names of both sides as sequences: left ones as bits telling where each kind of character stands, right ones as kinds.

    The kinds are the characters of the left names, put together where they are more than SEQUENCE_KINDS.
    """

    def __init__(self, left: list[str], right: list[str]):
        (self.size_a, _, codes_a), (self.size_b, self.start_b, codes_b) = map(self._codes, (left, right))
        known = np.unique(codes_a)
        self.kinds_b = np.append(self._kinds(codes_b, known), SEQUENCE_KINDS)
        owner = np.repeat(np.arange(len(left)), self.size_a)
        place = np.arange(len(codes_a)) - np.repeat(np.cumsum(self.size_a) - self.size_a, self.size_a)
        at = np.flatnonzero(self.size_a[owner] <= SEQUENCE_CHARACTERS)
        row, place = owner[at] * (SEQUENCE_KINDS + 1) + self._kinds(codes_a[at], known), place[at]
        self.words = np.zeros((place.max(initial=0) // 64 + 1, len(left) * (SEQUENCE_KINDS + 1)), np.uint64)
        np.bitwise_or.at(self.words, (place // 64, row), np.uint64(1) << (place % 64).astype(np.uint64))

    @staticmethod
    def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(n) for n in names], np.int64)
        return sizes, np.cumsum(sizes) - sizes, np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")

    @staticmethod
    def _kinds(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, codes)
        there = known[np.minimum(at, len(known) - 1)] == codes if len(known) else np.zeros(len(codes), bool)
        return np.where(there, at % SEQUENCE_KINDS, SEQUENCE_KINDS)

    def bounds(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The sequence ratio that the longest common subsequence allows pairs (places in left, in right); 1 for long names.

        The characters in matching blocks are a common subsequence. Its length is found bit by bit for each right character:
        a place of the left name that ends a longer one than so far turns 0.
        """
        most = np.ones(len(own))
        short = np.flatnonzero((self.size_a[own] <= SEQUENCE_CHARACTERS) & (self.size_b[other] <= SEQUENCE_CHARACTERS))
        for k in range(0, len(short), SEQUENCES_AT_ONCE):
            at = short[k : k + SEQUENCES_AT_ONCE]
            first, size = own[at] * (SEQUENCE_KINDS + 1), self.size_b[other[at]]
            start = self.start_b[other[at]]
            ones = [np.full(len(at), ~np.uint64(0)) for _ in self.words]
            for nth in range(int(size.max(initial=0))):
                row = first + np.where(nth < size, self.kinds_b[np.minimum(start + nth, len(self.kinds_b) - 1)], SEQUENCE_KINDS)
                carry = None
                for w, held in enumerate(self.words):
                    here = held.take(row)
                    met = ones[w] & here
                    total = ones[w] + met
                    over = total < met
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over
                    ones[w] = total | (ones[w] & ~here)
            common = 64 * len(ones) - sum(np.bitwise_count(x).astype(np.int64) for x in ones)
            most[at] = 2 * common / np.maximum(self.size_a[own[at]] + size, 1)
        return most


def best_of(left: list[str], right: list[str], order: list[str], ratio: float, most_pairs: int) -> tuple[list[int], list[int]]:
    """Places (in left, in right) of the most_pairs best pairs of each left name, of those with the sequence ratio.

    Of equal ratios those first in `order` count, a text for each right name. Pairs that share a word, or one of which
    holds the other, are left out. Ratios are computed for the highest bounds first, and then for those not below the
    ratios found, so that no other pair can be among the best. Bounds are by counts for all pairs, then by sequence.
    """
    found_a: list[int] = []
    found_b: list[int] = []
    own_words, words = [[frozenset(n.split()) for n in side] for side in (left, right)]
    place = np.empty(len(right), np.int64)
    place[sorted(range(len(right)), key=lambda j: (order[j], right[j]))] = np.arange(len(right))
    first = min(most_pairs + 5, len(right))

    sequences = _Sequences(left, right)

    def least_of(best: dict[int, list[tuple[float, int, int]]]) -> np.ndarray:
        """What a ratio of each name of the run must reach to be among its best."""
        return np.array([-b[-1][0] if len(b) == most_pairs else ratio for b in best.values()]) - _SLACK

    def compare(own: np.ndarray, other: np.ndarray, best: dict[int, list[tuple[float, int, int]]]) -> None:
        """The ratios of the pairs that their sequences leave, the most promising ones of each name first."""
        bound, run = sequences.bounds(own, other), next(iter(best))
        hopeful = np.flatnonzero(bound >= least_of(best)[own - run])
        by_bound = hopeful[np.lexsort((-bound[hopeful], own[hopeful]))]
        own, other, bound = own[by_bound], other[by_bound], bound[by_bound]
        later = np.arange(len(own)) - np.searchsorted(own, own) >= most_pairs
        score(own[~later], other[~later], best)
        later &= bound >= least_of(best)[own - run]
        score(own[later], other[later], best)

    def score(own: np.ndarray, other: np.ndarray, best: dict[int, list[tuple[float, int, int]]]) -> None:
        for start in range(0, len(own), RATIOS_AT_ONCE):
            pairs = zip(own[start : start + RATIOS_AT_ONCE].tolist(), other[start : start + RATIOS_AT_ONCE].tolist(), strict=True)
            some = [(i, j) for i, j in pairs if right[j] not in left[i] and left[i] not in right[j] and own_words[i].isdisjoint(words[j])]
            scores = sequence_ratios([left[i] for i, _ in some], [right[j] for _, j in some]).tolist()
            touched = set()
            for (i, j), score in zip(some, scores, strict=True):
                if score >= ratio - _SLACK:
                    best[i].append((-round(score, 12), int(place[j]), j))
                    touched.add(i)
            for i in touched:
                best[i] = sorted(best[i])[:most_pairs]

    for rows, most in _bounds(_Counted(left), _Counted(right), ratio):
        best: dict[int, list[tuple[float, int, int]]] = {i: [] for i in rows.tolist()}
        top = np.argpartition(most, len(right) - first, axis=1)[:, len(right) - first :]
        nth = np.arange(len(rows))[:, None]
        hopeful = most[nth, top] >= ratio - _SLACK
        compare(np.repeat(rows, first)[hopeful.ravel()], top[hopeful], best)
        most[nth, top] = -1
        for share in (4, 16, 64, 256, None):
            least = least_of(best).astype(np.float32)
            own, other = np.nonzero(most >= least[:, None])
            if not len(own):
                break
            if share:
                # The highest bounds of each name; what they give may do without the others.
                bound = most[own, other]
                by_bound = np.lexsort((-bound, own))
                own, other = own[by_bound], other[by_bound]
                kept = np.arange(len(own)) - np.searchsorted(own, own) < share * first
                own, other = own[kept], other[kept]
            compare(rows[own], other, best)
            most[own, other] = -1
        for i, pairs in best.items():
            found_a += [i] * len(pairs)
            found_b += [j for _, _, j in pairs]
    return found_a, found_b


def best_pairs(keys: DataFrame, sources: DataFrame, ratio: float, most_pairs: int) -> DataFrame:
    """(key), (key, first) -> (a, b): for each a at least its most_pairs best pairs of those with the sequence ratio.

    Every name of one side is compared with every one of the other, in blocks of bounded size on either side, each pair of
    blocks as one by best_of, so that a name brings no more than most_pairs rows for each block of source names.
    """
    left, right = keys.filter("key <> ''").select("key"), sources.filter("key <> ''").select("key", "first")
    n_left, n_right = left.count(), right.count()
    left_parts, right_parts = math.ceil(n_left / LEFT_NAMES) or 1, math.ceil(n_right / RIGHT_NAMES) or 1

    def located(side: DataFrame, own: str, parts: int, other: str, other_parts: int) -> DataFrame:
        placed = side.withColumn(own, F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1))))

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names_a, names_b = a["key"].tolist(), b["key"].tolist()
        at_a, at_b = best_of(names_a, names_b, b["first"].fillna("").tolist(), ratio, most_pairs) if names_a and names_b else ([], [])
        return pd.DataFrame({"a": [names_a[i] for i in at_a], "b": [names_b[j] for j in at_b]}, columns=["a", "b"], dtype=object)

    cells = ("left", "right")
    # A task for each pair of blocks: their few bytes are much work, which the size of a shuffle does not tell.
    tasks = min(left_parts * right_parts, MOST_TASKS)
    sides = (
        located(left, "left", left_parts, "right", right_parts).repartition(tasks, *cells),
        located(right, "right", right_parts, "left", left_parts).repartition(tasks, *cells),
    )
    met = sides[0].groupBy(*cells).cogroup(sides[1].groupBy(*cells))
    return met.applyInPandas(compared, "a string, b string")


def character_tokens(key: str, order: str) -> Column:
    """The characters of a short name numbered per kind, rarest first: 'anna' gives second n, n, second a, a.

    order has the characters from rare to common. As sets the tokens overlap in exactly as many as the names share
    characters. NULL for long names.
    """
    return F.expr(character_tokens_sql(key, order))


def character_tokens_sql(key: str, order: str) -> str:
    nth = f"length(substring({key}, 1, i)) - length(replace(substring({key}, 1, i), substring({key}, i, 1), ''))"
    rank = f"instr('{order}', substring({key}, i, 1))"
    token = f"concat(lpad({rank}, 4, '0'), lpad(99 - ({nth}), 2, '0'), substring({key}, i, 1))"
    tokens = f"sort_array(transform(sequence(1, length({key})), i -> {token}))"
    return f"if(length({key}) BETWEEN 1 AND {SHORT_NAME}, {tokens}, NULL)"


def needed_characters(a: str, b: str, ratio: float) -> str:
    """How many characters two names must share for the given sequence ratio."""
    return f"greatest(ceil({ratio}D * (length({a}) + length({b})) / 2 - 1e-9D), 1)"


def _length_ratio(ratio: float) -> float:
    """Two names with this sequence ratio: the shorter has at least this share of the longer one's length."""
    return ratio / (2 - ratio)


def _prefix(key: str, toks: str, ratio: float) -> str:
    """The tokens of a name among which those it shares with an alike one begin."""
    size = f"length({key})"
    return f"slice({toks}, 1, {size} - CAST(ceil({_length_ratio(ratio)}D * {size} - 1e-9D) AS int) + 2)"


def character_probes(key: str, toks: str, ratio: float, indexed: bool, class_kind: str | None = "l") -> str:
    """Probes of kinds q and l: two names of sequence ratio >= ratio (0 < ratio < 1) have one in common.

    They share at least r(|a|+|b|)/2 characters. Where that is two or more, the two rarest shared tokens are among
    the first |a| - f|a| + 2 tokens of a (f the length ratio), and likewise for b: pairs of tokens from that prefix
    are the probes. Tiny names, which may share one character only, add their single tokens. Long names meet by
    length class, the indexed side being present in the neighbouring classes too; without class_kind they have none.
    """
    none = "cast(array() AS array<string>)"
    shrink, size = _length_ratio(ratio), f"length({key})"
    prefix = _prefix(key, toks, ratio)
    pairs = f"flatten(transform({prefix}, (x, i) -> transform(slice({prefix}, i + 2, {size}), y -> concat(x, y))))"
    singles = f"if({size} < {2 / ratio}D, {toks}, {none})"
    length_class = f"CAST(floor(ln({size}) / -ln({shrink}D)) AS int)"
    classes = f"sequence({length_class} - 1, {length_class} + 1)" if indexed else f"array({length_class})"
    long_names = f"if({size} > {SHORT_NAME * shrink}D, {probes.tagged(class_kind, classes)}, {none})" if class_kind else none
    return f"concat(coalesce({probes.tagged('q', pairs)}, {none}), coalesce({probes.tagged('q', singles)}, {none}), {long_names})"
