from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemalign.llm import multi_index

SCHEMA = "vec_id long, label long, v array<int>"


def brute(rows, anchor):
    """The plain search over (vec_id, label, v), nothing left out."""
    rows = [r for r in rows if None not in r[:3]]
    out = []
    dims = max((len(r[2]) for r in rows), default=0)
    x = [np.array([*map(int, r[2]), *[0] * (dims - len(r[2]))], dtype=object) for r in rows]
    for a, (anchor_id, label, _) in enumerate(r[:3] for r in rows):
        if not anchor(anchor_id):
            continue
        scored = [(-int((x[a] * x[b]).sum()) if dims else 0, rows[b][0], rows[b][1] == label) for b in range(len(rows)) if b != a]
        for score, positive_id, same in sorted(s for s in scored if s[2])[:5]:
            p = -score
            fits = sorted((s, n) for s, n, alike in scored if not alike and 80 * p <= 100 * -s <= 100 * p)
            out += [(anchor_id, positive_id, k, n, p, -s) for k, (s, n) in enumerate(fits[:5], 1)]
    return sorted(out)


def mined(df, every=5, **limits):
    return sorted(map(tuple, multi_index.hard_negatives(df, F.col("vec_id") % every == 0, **limits).collect()))


@pytest.mark.parametrize("first_rows", [8, 100_000])
def test_same_as_a_full_search_with_ties_and_copies(spark, first_rows):
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(6, 9))
    rows = [(k, int(draw.integers(4)), np.floor(20 * (centers[k % 6] + 0.4 * draw.normal(size=9))).astype(int).tolist()) for k in range(300)]
    rows += [(300 + k, k % 3, rows[5][2]) for k in range(80)]  # one vector in many rows
    rows += [(400, 99, rows[0][2]), (405, 98, rows[1][2]), (410, 98, rows[2][2])]  # labels of one and two rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert mined(df, first_rows=first_rows) == brute(rows, lambda i: i % 5 == 0)


def test_rows_that_take_no_part_and_clashing_columns(spark):
    schema = "vec_id long, label int, embedding array<float>, row string, v string, cell int, anchor string"
    extra = ("x", "y", 1, "z")
    rows = [(k, k % 2, [0.5 + k / 50, 0.25, float(k % 3)], *extra) for k in range(20)]
    rows += [(20, None, [1.0, 1.0, 1.0], *extra), (25, 0, None, *extra), (30, 0, [1.0, None, 1.0], *extra), (35, 1, [math.nan, 1.0, 1.0], *extra)]
    rows += [(40, 1, [math.inf, 0.0, 0.0], *extra), (None, 1, [1.0, 1.0, 1.0], *extra), (45, 1, [1e30, 0.0, 0.0], *extra), (50, 0, [], *extra)]
    rows += [(55, 0, [2.0, 1.0], *extra), (55, 1, [2.0, 1.0, 0.5, 3.0], *extra), (-5, 1, [0.0, 0.0, 0.0], *extra)]
    df = spark.createDataFrame(rows, schema).withColumn("v", multi_index.scaled("embedding"))
    plain = []
    for vec_id, label, e, *_ in rows:
        bad = e is None or any(x is None or not math.isfinite(x) or abs(x) > 1e6 for x in e)
        plain.append((vec_id, label, None if bad else [math.floor(256 * np.float32(x).astype(float)) for x in e]))
    assert mined(df) == brute(plain, lambda i: i % 5 == 0)


def test_large_numbers_are_exact(spark):
    draw = np.random.default_rng(6)
    rows = [(k, k % 2, draw.integers(2**28, 2**29, 4).tolist()) for k in range(40)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows, lambda i: i % 5 == 0)
    a, b = np.array([r[2] for r in rows[:3]], np.int32), np.array([r[2] for r in rows[3:6]], np.int32)
    assert multi_index.products(a, b).tolist() == [[sum(map(int.__mul__, map(int, x), map(int, y))) for y in b] for x in a]


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 0, [1, 2]), (2, 0, [2, 3])], SCHEMA)) == []
    assert mined(spark.createDataFrame([(5, 0, [1, 2])], SCHEMA)) == []


def test_cells_come_by_falling_bounds_that_hold(spark):
    draw = np.random.default_rng(9)
    x = draw.integers(-90, 90, (400, 6))
    rows = [(k, 0, v) for k, v in enumerate(x.tolist())]
    base = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, vec_id long, label long, v array<int>")
    index = multi_index.build(base, cell_rows=4)
    cells = {}
    for b in index.blocks.collect():
        cells.setdefault(b["cell"], []).extend(np.frombuffer(b["vec_ids"], "<i8").tolist())
    assert sorted(itertools.chain(*cells.values())) == list(range(400)) and index.book.rows.sum() == 400
    for q in x[:10].astype(float):
        walked = list(index.book.walk(q))
        bounds = [bound for bound, _ in walked]
        assert bounds == sorted(bounds, reverse=True) and len(walked) == len({c for _, c in walked}) == index.book.rows.size
        for bound, cell in walked:
            assert all(q @ x[k] <= bound for k in cells.get(cell, ()))


def test_search_visits_few_rows(spark):
    """On vectors in clusters a query is certified before half of the rows are read."""
    draw = np.random.default_rng(2)
    centers = 60 * draw.normal(size=(40, 8))
    x = np.floor(centers[draw.integers(40, size=4000)] + draw.normal(size=(4000, 8))).astype(int)
    base = spark.createDataFrame([(k, k, k % 2, v) for k, v in enumerate(x.tolist())], "row long, vec_id long, label long, v array<int>")
    index = multi_index.build(base, cell_rows=16)
    read = []
    for k in range(0, 4000, 400):
        scores = np.sort(x @ x[k])[::-1]
        at, rows = index.book.rows.ravel(), 0
        for bound, cell in index.book.walk(x[k].astype(float)):
            if bound < scores[10]:
                break
            rows += at[cell]
        read.append(rows)
    assert np.mean(read) < 2000
