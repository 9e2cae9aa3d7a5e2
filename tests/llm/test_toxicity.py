"""The learned lexicon: automata against plain edit distances, held-out accuracy, odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemalign.llm import toxicity
from schemalign.llm.toxicity import Matcher, Term


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


TERMS = [Term("idiot", False, [9, 5]), Term("idea", False, [1]), Term("worthless", False, [9, 5, 2]), Term("lowei", True, [8, 4]), Term("abab", True, [3, 2, 1])]
MATCHER = Matcher(TERMS)


def plain_matches(word):
    found = {}
    for k, term in enumerate(TERMS):
        tried = [word] if not term.stem else [word[:n] for n in range(len(word) + 1)]
        best = min(distance(w, term.text) for w in tried)
        if best <= term.edits:
            found[k] = best
    return tuple(sorted(found.items()))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("idotwrhlesabé"), max_size=11) | st.sampled_from(["idiot", "idi0t", "ididot", "wrthles", "loweisch", "lowisch", "xlowei"]))
def test_automata_give_plain_distances(word):
    assert MATCHER._read(word) == plain_matches(word)


def test_marks_and_quotes():
    assert MATCHER.match('"Idiot!",') == ((0, 0),) and MATCHER.match("***") == ()
    said = lambda t: toxicity.evidence(t, MATCHER)
    assert said("you idiot.") == (9, 0, 9) and said('he wrote "you idiot" there') == (0, 9, 0)
    assert said('"so" you idiot and "more"') == (9, 0, 9)
    assert said(None) == said("") == said(" \n ") == (0, 0, 0)


def corpus(seed):
    rng = random.Random(seed)
    syllables = "ba de fi go hu ka le mi no pu ra se ti vo wu za".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = k % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            bad = rng.choice(["idiot", "scoundrel", "wretched", "moloch" + word()])
            words.insert(rng.randrange(len(words)), bad)
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_documents(rows):
    docs, labels = corpus(1)
    extra = [(1000, "you idoit scoundrel scundrel"), (1001, None), (1002, ""), (None, "wretched idiot wretched"), (5, docs[5][1]), (1003, "x " * 30_000)]
    df = rows([(*d, "s") for d in docs + extra], "doc_id long, text string, score string")
    known = rows(labels + [(5, None), (7777, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, known)
    assert {t.text for t in model.terms} >= {"idiot", "scoundrel", "wretched"} and any(t.stem and "moloch".startswith(t.text[:6]) for t in model.terms)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r.predicted for r in got}
    out = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([by_id[k] == (k % 5 == 0) for k in out]) > 0.97
    assert by_id[1000] == 1 and by_id[None] == 1 and by_id[1001] == by_id[1002] == by_id[1003] == 0
    kept = toxicity.clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_held_out_labels_are_not_looked_at(rows):
    docs, labels = corpus(2)
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    df = rows(docs, "doc_id long, text string")
    a, b = (toxicity.learn(df, rows(known, "doc_id long, toxic int")) for known in (labels, flipped))
    assert a.terms == b.terms and np.allclose(a.coefficients, b.coefficients)
    ids = rows([(k,) for k in range(50)], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids)


def test_nothing_to_learn(rows):
    empty = rows([], "doc_id long, text string")
    labels = rows([], "doc_id long, toxic int")
    model = toxicity.learn(empty, labels)
    assert toxicity.score(empty, model).collect() == []
    assert [r.predicted for r in toxicity.score(rows([(1, "idiot")], "doc_id long, text string"), model).collect()] == [0]


def test_a_task_without_words(spark):
    docs = spark.createDataFrame([(1, "11 22"), (2, "!"), (3, None), (4, "これは一つだけの文書です")], "doc_id long, text string").repartition(4, "doc_id")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert toxicity.score(docs, model).count() == 4
