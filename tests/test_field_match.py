from __future__ import annotations

import random

import pytest

from brute_force import Lexicon
from schemalign.plans.field_match import SCORES, field_match, field_match_names

GOLDEN_DICTIONARY = [
    ("CUST_NM", "Customer Name"),
    ("Customer Name", "Customer Name"),
    ("ORDER_DT", "Order Date"),
    ("Order Date", "Order Date"),
    ("TOT_PRC", "Total Price"),
    ("Total Price", "Total Price"),
]
GOLDEN = [
    ("Order-Date", "Order Date", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1),
    ("Order-Date", "ORDER_DT", 0.1089, 0.0, 0.0, 0.7778, 0.0, 0.0, 2),
    ("ORDER_DATE", "Order Date", 0.126, 0.0, 0.0, 0.9, 0.0, 0.0, 1),
    ("ORDER_DATE", "ORDER_DT", 0.1244, 0.0, 0.0, 0.8889, 0.0, 0.0, 2),
    ("Customer", "Customer Name", 0.4899, 0.0, 1.0, 0.7619, 0.5, 0.5774, 1),
    ("Total  Price!", "Total Price", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1),
    ("", "CUST_NM", 0.14, 0.0, 1.0, 0.0, 0.0, 0.0, 1),
    ("", "Customer Name", 0.14, 0.0, 1.0, 0.0, 0.0, 0.0, 2),
    ("", "ORDER_DT", 0.14, 0.0, 1.0, 0.0, 0.0, 0.0, 3),
]


def frames(spark, names, rows):
    inputs = spark.createDataFrame(list(enumerate(names)), "pos int, input_field string")
    return inputs, spark.createDataFrame(rows, "src string, target string")


def check(spark, names, rows, top_n, threshold, **options):
    inputs, dictionary = frames(spark, names, rows)
    got = {}
    for r in field_match(inputs, dictionary, top_n, threshold, **options).orderBy("pos", "match_rank").collect():
        got.setdefault(r["pos"], []).append((r["src_field"], r["target_field"], *(r[s] for s in SCORES), r["match_rank"]))
    lexicon = Lexicon(rows)
    for pos, name in enumerate(names):
        want = lexicon.match(name, top_n, threshold)
        have = got.get(pos, [])
        assert [w[:2] + w[-1:] for w in want] == [h[:2] + h[-1:] for h in have], (name, want, have)
        for w, h in zip(want, have, strict=True):
            assert h[2:-1] == pytest.approx(w[2:-1], abs=1.01e-4)


def test_golden_rows(spark):
    names = ["Order-Date", "ORDER_DATE", "Customer", "Total  Price!", "", "zzz"]
    inputs, dictionary = frames(spark, names, GOLDEN_DICTIONARY)
    rows = field_match(inputs, dictionary).orderBy("pos", "match_rank").collect()
    kept = [tuple(r[c] for c in ("input_field", "src_field", *SCORES, "match_rank")) for r in rows]
    assert [k for k in kept if k in GOLDEN] == GOLDEN
    check(spark, names, GOLDEN_DICTIONARY, 3, 0.1)


def test_call_form(spark):
    dictionary = spark.createDataFrame(GOLDEN_DICTIONARY, "src string, target string")
    rows = field_match_names(spark, ["Total Price", "Order-Date"], dictionary, 1).collect()
    assert [(r["input_field"], r["target_field"]) for r in rows] == [("Total Price", "Total Price"), ("Order-Date", "Order Date")]
    assert field_match_names(spark, ["x"], dictionary).columns == [
        "input_field", "src_field", "target_field", *SCORES, "match_rank"
    ]


WORDS = ["order", "date", "cust", "customer", "name", "total", "price", "id", "a", "x", "dt", "amount", "line", "no", "né"]


def random_names(rng, n):
    names = []
    for _ in range(n):
        picked = [rng.choice(WORDS) for _ in range(rng.randint(1, 4))]
        name = rng.choice([" ", "_", "-", "", " "]).join(picked)
        if rng.random() < 0.4:
            spot = rng.randrange(len(name) + 1)
            name = name[:spot] + rng.choice(["", "z", "7", "."]) + name[spot + rng.randint(0, 2) :]
        names.append(name.upper() if rng.random() < 0.3 else name)
    return names


@pytest.mark.parametrize("threshold", [0.0, 0.03, 0.1, 0.2, 0.4])
@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0, "rows_per_task": 7}])
def test_equals_all_pairs(spark, threshold, options):
    rng = random.Random(int(threshold * 100) + len(options))
    srcs = random_names(rng, 60) + ["", "?", "x", "order date", "order date"]
    rows = [(s, "T%d" % (i % 9)) for i, s in enumerate(srcs)]
    names = random_names(rng, 50) + ["", None, "x", "order-date", "order-date", "?!", "q", "ordr_dte", "e"]
    check(spark, names, rows, 3, threshold, **options)


def test_no_terms_at_all(spark):
    check(spark, ["a b", "a", "c", "ab", ""], [("a", "A"), ("b a", "B"), ("c d e", "C")], 3, 0.1)
    check(spark, ["a b", "a", "c", "ab", ""], [("a", "A"), ("b a", "B"), ("c d e", "C")], 2, 0.0)


def test_long_names(spark):
    rng = random.Random(5)
    long_names = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(10, 60))) for _ in range(25)]
    blobs = ["".join(rng.choice("abcd") for _ in range(rng.randint(50, 130))) for _ in range(25)]
    rows = [(s, s[:5]) for s in long_names[:15] + blobs[:15]]
    names = long_names[10:] + blobs[10:] + [n[5:90] for n in long_names[:5]]
    for threshold in (0.05, 0.3):
        check(spark, names, rows, 3, threshold)
    check(spark, names, rows, 3, 0.1, broadcast_keys=0, rows_per_task=20)


def test_repeated_sources_share_the_last_target(spark):
    rows = [("nm", "A"), ("nm", "C"), ("nm", "B"), ("NM", None), (None, "N")]
    check(spark, ["nm", "Nm!", "x"], rows, 5, 0.1)
