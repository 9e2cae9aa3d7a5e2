"""Long names that share characters only: compared by counts in blocks, none lost, none beyond the bounds."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemalign.operators import characters


def _names(draw, n, length, alphabet="abcdefgh_"):
    base = ["".join(draw.choices(alphabet, k=length)) for _ in range(6)]
    made = []
    for k in range(n):
        letters = list(base[k % 6])
        for _ in range(draw.randrange(length // 2)):
            at = draw.randrange(len(letters) + 1)
            letters[at : at + draw.randrange(3)] = draw.choices(alphabet, k=draw.randrange(3))
        made.append("".join(letters))
    return sorted(set(made))


def _bounds(a, b, ratio):
    def shared(x, y):
        return sum(min(x.count(e), y.count(e)) for e in set(x))

    pairs = [[t[i : i + 2] for i in range(len(t) - 1)] for t in (a, b)]
    total = len(a) + len(b)
    return shared(a, b) >= ratio * total / 2 - 1e-9, shared(*pairs) >= total * (1.5 * ratio - 1) - 1 - 1e-6


@pytest.mark.parametrize("ratio", [0.714, 0.8, 0.9])
def test_counts_lose_no_pair(ratio):
    draw = random.Random(int(ratio * 100))
    left, right = _names(draw, 60, 80), _names(draw, 60, 90) + _names(draw, 10, 260, "abc")
    found = set(zip(*[x.tolist() for x in characters.within_counts(left, right, ratio)], strict=True))
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if SequenceMatcher(None, a, b).ratio() >= ratio:
                assert (i, j) in found
            if (i, j) in found:  # letters of nine kinds are a group each, so the bounds are exact
                assert _bounds(a, b, ratio)[0]


def test_three_hundred_by_six_hundred_alike_names(spark):
    draw = random.Random(4)
    left, right = _names(draw, 300, 73), _names(draw, 600, 73)
    sides = [spark.createDataFrame([(n,) for n in x], "key string") for x in (left, right)]
    pairs = {tuple(r) for r in characters.long_pairs(*sides, 0.8, block_names=64).collect()}
    long = {(a, b) for a in left for b in right if max(len(a), len(b)) > 64 and min(len(a), len(b)) > 64 * 0.8 / 1.2}
    assert {p for p in long if all(_bounds(*p, 0.8))} <= pairs  # groups may let a pair too many through, not one too few
    assert pairs <= {p for p in long if _bounds(*p, 0.8)[0]} and len(pairs) < 0.7 * len(long)
    whole = {tuple(r) for r in characters.pairs_by_index(*sides, 0.8, 10_000).collect()}
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert want <= whole and {p for p in pairs if max(map(len, p)) > 64} >= whole - {p for p in whole if max(map(len, p)) <= 64}


def test_short_and_long_sides_meet_once(spark):
    draw = random.Random(9)
    left, right = _names(draw, 40, 60), _names(draw, 40, 66)
    sides = [spark.createDataFrame([(n,) for n in x], "key string") for x in (left, right)]
    found = characters.pairs_by_index(*sides, 0.75, 1000).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] == 1 for r in found)
    assert {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= 0.75} <= {(r["a"], r["b"]) for r in found}


def _best(left, right, ratio, most):
    """(a, b) by the standard matcher, equal ratios in order of the reversed name."""
    found = set()
    for a in left:
        alike = [b for b in right if a not in b and b not in a and not set(a.split()) & set(b.split())]
        scored = sorted((-SequenceMatcher(None, a, b).ratio(), b[::-1], b) for b in alike)
        found |= {(a, b) for score, _, b in scored[:most] if -score >= ratio}
    return found


@pytest.mark.parametrize("features", [24, 512])
@pytest.mark.parametrize("ratio, most, length", [(0.714, 3, 14), (0.9, 1, 75), (0.3, 2, 240)])
def test_best_pairs_by_bounds(monkeypatch, features, ratio, most, length):
    monkeypatch.setattr(characters, "FEATURES", features)
    draw = random.Random(length)
    left, right = _names(draw, 40, length, "ab cdé_0"), _names(draw, 60, length, "ab cdé_0")
    left, right = [sorted({" ".join(n.split()) for n in x}) for x in (left, right)]
    right = sorted({*right, *(b[1:] + b[0] for b in left)})
    at = characters.best_of(left, right, [b[::-1] for b in right], ratio, most)
    assert {(left[i], right[j]) for i, j in zip(*at, strict=True)} == _best(left, right, ratio, most)


def test_best_pairs_give_few_rows_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(characters, "LEFT_NAMES", 50)
    monkeypatch.setattr(characters, "RIGHT_NAMES", 100)
    left, right = [f"customer{k}x" for k in range(120)], [f"customer{k}" for k in range(1000, 1300)]
    sides = [spark.createDataFrame([(n, n[::-1]) for n in x], "key string, first string") for x in (left, right)]
    found = [tuple(r) for r in characters.best_pairs(*sides, 0.714, 2).collect()]
    assert len(set(found)) == len(found) <= 120 * 3 * 2  # 36,000 pairs are within the bound
    assert _best(left, right, 0.714, 2) <= set(found)


def _subsequence(a, b):
    lengths = [0] * (len(b) + 1)
    for x in a:
        made = [0]
        for j, y in enumerate(b):
            made.append(lengths[j] + 1 if x == y else max(lengths[j + 1], made[j]))
        lengths = made
    return lengths[-1]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh 0123", "".join(map(chr, range(0x4E00, 0x4EC8)))])
def test_bounds_by_sequence(alphabet):
    draw = random.Random(len(alphabet))
    name = lambda most: "".join(draw.choices(alphabet, k=draw.randint(0, most)))
    left, right = [[*(name(n) for n in (5, 64, 65, 130, 256, 300)), "", "a" * 64, "a" * 256] for _ in range(2)]
    pairs = [(i, j) for i in range(len(left)) for j in range(len(right))]
    found = characters._Sequences(left, right).bounds(*np.array(pairs).T)
    for (i, j), bound in zip(pairs, found.tolist(), strict=True):
        true = 2 * _subsequence(left[i], right[j]) / max(len(left[i]) + len(right[j]), 1)
        if max(len(left[i]), len(right[j])) > 256:
            assert bound == 1
        else:
            assert bound >= true - 1e-12 and (len(alphabet) > 64 or bound <= true + 1e-12)


def test_few_ratios_are_computed(monkeypatch):
    """Names alike in their counts: most ratios are spared by the longest common subsequence."""
    draw = random.Random(5)
    names = [f"x{d * 6}{d[::-1]}{'customer' * 4}" for d in sorted({f"{draw.randrange(10**6):06}" for _ in range(1500)})]
    left, right = [n + "z" for n in draw.sample(names, 8)], draw.sample(names, 500)
    seen = []
    ratios = characters.sequence_ratios
    monkeypatch.setattr(characters, "sequence_ratios", lambda a, b: seen.extend(a) or ratios(a, b))
    found = characters.best_of(left, right, [b[::-1] for b in right], 0.8, 1)
    assert len(seen) < 40
    assert {(left[i], right[j]) for i, j in zip(*found, strict=True)} == _best(left, right, 0.8, 1)
