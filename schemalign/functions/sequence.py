"""The one similarity Spark has no expression for: the matching-blocks ratio of two strings.

A batch of pairs is compared at once: every open stretch of every pair looks for its longest common block by one pass
over the characters of its first side, all stretches in step, and is split at that block until nothing is in common.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Very frequent characters of a second string of this length or more start no block; they only lengthen one.
POPULAR_FROM = 200

# Longer strings go to the standard matcher, which indexes characters instead of comparing all.
MOST_CHARACTERS = 400

# Characters of second strings that are compared in one step: what a core's cache holds.
AT_ONCE = 1 << 15

_NO_A, _NO_B, _POPULAR = 0x110000, 0x110001, 0x110002


def _popular(b: str) -> set[str]:
    counts: dict[str, int] = {}
    for ch in b:
        counts[ch] = counts.get(ch, 0) + 1
    most = len(b) // 100 + 1
    return {ch for ch, n in counts.items() if n > most}


class _Strings:
    """Strings behind each other as code points, with where each begins."""

    def __init__(self, values: list[str]):
        self.sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if values else np.zeros(0, np.int64)
        joined = "".join(values).encode("utf-32-le", "surrogatepass")
        self.codes = np.concatenate([np.frombuffer(joined, "<u4"), np.zeros(1, "<u4")]).astype(np.int32)


def _window(codes: np.ndarray, start: np.ndarray, size: np.ndarray, filler: int) -> np.ndarray:
    """(characters, stretches) from start on, filled up behind size."""
    nth = np.arange(int(size.max()))[:, None]
    return np.where(nth < size, codes[np.minimum(start + nth, len(codes) - 1)], filler)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in a, start in b) of the longest common block of each column, the earliest in a, then in b.

    A run's number is its length in units of a's width; what is left below says how early it ends in a.
    """
    unit, columns = len(a), a.shape[1]
    kind = np.int16 if unit * min(unit, len(b)) + unit < 1 << 15 else np.int32
    before, now = np.zeros((len(b) + 1, columns), kind), np.zeros((len(b) + 1, columns), kind)
    ranked, best = np.empty((len(b), columns), kind), np.zeros((len(b), columns), kind)
    for i in range(unit):
        np.add(before[:-1], kind(unit), out=now[1:])
        np.multiply(now[1:], b == a[i], out=now[1:])
        np.add(now[1:], kind(unit - 1 - i), out=ranked)
        np.maximum(best, ranked, out=best)
        before, now = now, before
    at = best.argmax(axis=0)
    size, left = np.divmod(best[at, np.arange(columns)].astype(np.int64), unit)
    return size, unit - left - size, at + 1 - size


def _lengthened(codes_a, codes_b, lo_a, hi_a, lo_b, hi_b, i, j, k):
    """Blocks lengthened by equal characters on either side, which popular ones have kept out of them."""
    while True:
        more = np.flatnonzero((i > lo_a) & (j > lo_b))
        more = more[codes_a[i[more] - 1] == codes_b[j[more] - 1]]
        if not len(more):
            break
        i[more], j[more], k[more] = i[more] - 1, j[more] - 1, k[more] + 1
    while True:
        more = np.flatnonzero((i + k < hi_a) & (j + k < hi_b))
        more = more[codes_a[i[more] + k[more]] == codes_b[j[more] + k[more]]]
        if not len(more):
            return i, j, k
        k[more] += 1


def _steps(size_a: np.ndarray, size_b: np.ndarray) -> list[np.ndarray]:
    """Stretches of like size together, as many as may be compared at once."""
    order = np.lexsort((size_a, size_b // 8))
    steps, start = [], 0
    while start < len(order):
        end = min(len(order), start + max(1, AT_ONCE // int(size_b[order[start]] // 8 * 8 + 8)))
        steps.append(order[start:end])
        start = end
    return steps


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """2M / (|a| + |b|) of each pair, M being the characters in matching blocks; 1 for two empty strings.

    Blocks are those of the standard matcher: the longest first, of equal ones the earliest in a, then in b, and the
    same on both sides of it.
    """
    a, b = _Strings(left), _Strings(right)
    seeds = b.codes
    if len(b.sizes) and b.sizes.max() >= POPULAR_FROM:
        seeds = b.codes.copy()
        for k in np.flatnonzero(b.sizes >= POPULAR_FROM):
            popular = _popular(right[k])
            if popular:
                own = slice(b.starts[k], b.starts[k] + b.sizes[k])
                seeds[own][np.isin(seeds[own], [ord(ch) for ch in popular])] = _POPULAR
    matched = np.zeros(len(left), np.int64)
    pair = np.arange(len(left))
    open_ = [pair, a.starts, a.starts + a.sizes, b.starts, b.starts + b.sizes]
    while len(open_[0]):
        some = (open_[2] > open_[1]) & (open_[4] > open_[3])
        open_ = [x[some] for x in open_]
        following: list[list[np.ndarray]] = []
        for step in _steps(open_[2] - open_[1], open_[4] - open_[3]) if len(open_[0]) else []:
            own, lo_a, hi_a, lo_b, hi_b = (x[step] for x in open_)
            k, i, j = _longest(_window(a.codes, lo_a, hi_a - lo_a, _NO_A), _window(seeds, lo_b, hi_b - lo_b, _NO_B))
            i, j = np.where(k > 0, lo_a + i, lo_a), np.where(k > 0, lo_b + j, lo_b)
            if seeds is not b.codes:
                i, j, k = _lengthened(a.codes, b.codes, lo_a, hi_a, lo_b, hi_b, i, j, k)
            np.add.at(matched, own, k)
            found = k > 0
            for low_a, high_a, low_b, high_b in ((lo_a, i, lo_b, j), (i + k, hi_a, j + k, hi_b)):
                following.append([x[found] for x in (own, low_a, high_a, low_b, high_b)])
        open_ = [np.concatenate(x) for x in zip(*following, strict=True)] if following else [np.zeros(0, np.int64)] * 5
    total = a.sizes + b.sizes
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def _indexed_ratios(left: list[str], right: list[str]) -> list[float]:
    """The same for long strings; the matcher indexes its second one, so pairs are visited by it."""
    matcher, found, last = SequenceMatcher(None), [0.0] * len(left), None
    for k in sorted(range(len(left)), key=right.__getitem__):
        if right[k] != last:
            last = right[k]
            matcher.set_seq2(last)
        matcher.set_seq1(left[k])
        found[k] = matcher.ratio()
    return found


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio 2M/(|a|+|b|) per pair, NULL where either side is NULL."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
    left, right = a.to_numpy()[known].tolist(), b.to_numpy()[known].tolist()
    short = np.array([max(len(x), len(y)) <= MOST_CHARACTERS for x, y in zip(left, right, strict=True)], dtype=bool)
    for pick, compare in ((short, ratios), (~short, _indexed_ratios)):
        at = np.flatnonzero(pick)
        if len(at):
            out[known[at]] = compare([left[k] for k in at], [right[k] for k in at])
    return pd.Series(out).where(~np.isnan(out), None).astype("Float64")


# Declared nondeterministic so that a filter on the ratio is not pushed below, which would compute it twice.
sequence_ratio = sequence_ratio.asNondeterministic()
