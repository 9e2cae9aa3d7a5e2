from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from schemalign.llm import quality

WORDS = "the river runs over old stones and past a small mill where people met to talk about weather bread".split()


def _text(draw, good):
    words = [draw.choice(WORDS) + draw.choice(["", "", "s", "ed"]) for _ in range(draw.randint(5, 60))]
    if good:
        return " ".join(words).capitalize() + "."
    return " ".join(w + draw.choice(["###", "$$$"]) for w in words) if draw.random() < 0.5 else " | ".join(words)


def _is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(3)
    made = [(k, _text(draw, k % 4 > 0), int(k % 4 > 0)) for k in range(1500)]
    docs = spark.createDataFrame([(k, t, "xx", k) for k, t, _ in made], "doc_id long, text string, lang string, quality long").repartition(5)
    labels = spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, quality int")
    return docs, labels, {k: y for k, _, y in made}


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    found = quality.score(docs, quality.learn(docs, labels), 0.3).collect()
    assert len(found) == len(truth)
    held = [r for r in found if _is_held(r["doc_id"])]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_labels_of_the_held_out_fifth_change_nothing(spark, labelled):
    docs, labels, truth = labelled
    weights = quality.learn(docs, labels)
    wrong = spark.createDataFrame([(k, 1 - y if _is_held(k) else y) for k, y in truth.items()], "doc_id long, quality int")
    assert np.array_equal(weights, quality.learn(docs, wrong))


def test_sample_is_bounded_though_one_id_repeats(spark):
    docs = spark.range(0, 5000, 1, 4).selectExpr("1L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1)], "doc_id long, quality int")
    assert not _is_held(1)
    rows = quality.training_rows(docs, labels, 500).collect()
    assert 300 < len(rows) < 700 and {r["quality"] for r in rows} == {0.5}


def test_leader_equals_updates_by_the_book():
    draw = np.random.default_rng(1)
    leader, z, n = quality.Leader.new(), {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        sign = math.copysign(1, z[k])
        return -(z[k] - sign * quality.L1) / ((quality.SMOOTH + math.sqrt(n[k])) / quality.RATE + quality.L2)

    for _ in range(200):
        at = np.sort(draw.choice(12, 4, replace=False))
        values, label = draw.normal(size=4), float(draw.integers(2))
        w = {int(k): weight(int(k)) for k in at}
        p = 1 / (1 + math.exp(-sum(w[int(k)] * v for k, v in zip(at, values, strict=True))))
        for k, v in zip(at.tolist(), values, strict=True):
            g = (p - label) * v
            sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.RATE
            z[k] = z.get(k, 0.0) + g - sigma * w[k]
            n[k] = n.get(k, 0.0) + g * g
        leader.learn(at, values, label)
    assert np.allclose(leader.weights(np.arange(12)), [weight(k) for k in range(12)])


def _plain_features(text):
    import re

    known, counts = quality._Hashes(), {}
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    own = [known[t] for t in tokens]
    told = [15 if k and own[k] == own[k - 1] else h for k, h in enumerate(own)]
    wrapped = (1 << 64) - 1
    keys = list(told)
    keys += [(a * 3 & wrapped) ^ b for a, b in zip(told, told[1:], strict=False)]
    shapes = [h & 15 for h in told]
    keys += [(a << 8 | b << 4 | c) + (1 << 20) for a, b, c in zip(shapes, shapes[1:], shapes[2:], strict=False)]
    for key in keys:
        bucket = (key * int(quality._MIX) & wrapped) >> (64 - quality.BITS)
        counts[bucket] = counts.get(bucket, 0) + 1
    total = sum(counts.values())
    return {b: math.sqrt(c / total) for b, c in counts.items()} | {1 << quality.BITS: 1.0}


@pytest.mark.parametrize("chars", [7, 40, 1 << 20])
def test_features_are_the_same_in_slices(monkeypatch, chars):
    monkeypatch.setattr(quality, "_CHARS_AT_ONCE", chars)
    draw = random.Random(chars)
    for text in ["", " ", "one", "a a a a", "Ab!! c?\n\n---- 12 x1y", " ".join(draw.choice([*WORDS, "!!", "NO", "no,"]) for _ in range(300)), "x" * 100 + " y"]:
        at, values = quality.Features().of(text)
        assert dict(zip(at.tolist(), values.tolist(), strict=True)) == pytest.approx(_plain_features(text))


def test_odd_rows_and_no_rows(spark, labelled):
    docs, labels, _ = labelled
    weights = quality.learn(docs, labels)
    odd = [(1, None), (2, ""), (None, "river stones"), (3, "あ" * 50), (4, "word " * 300_000), (4, "mill"), (4, "mill")]
    found = quality.score(spark.createDataFrame(odd, "doc_id long, text string"), weights).collect()
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == 7 and by_id[1] == by_id[2] and all(0 <= r["score"] <= 1 for r in found)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(none, weights).count() == 0
    nothing = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not nothing.any() and not quality.learn(none, labels).any()
    held = spark.createDataFrame([(None,), (3,)], "doc_id long").select(quality.held_out(quality.F.col("doc_id")).alias("h")).collect()
    assert [r["h"] for r in held] == [False, _is_held(3)]
