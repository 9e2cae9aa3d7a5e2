"""SimHash near-duplicates against all pairs and plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from schemalign.llm import simhash


def plain_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, limit):
    ids = [i for i, _ in prints]
    low = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= limit and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


@pytest.mark.parametrize("limit", [0, 1, 3, 4, 7])
def test_chains_lose_no_link(spark, limit):
    rng = random.Random(limit)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for x in list(prints):
        for _ in range(3):
            for k in rng.sample(range(64), rng.randint(0, limit + 1)):
                x ^= 1 << k
            prints.append(x)
    prints = sorted(set(prints))
    want = plain_components(list(enumerate(prints)), limit)
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    found = simhash.links_of(spark.createDataFrame([(x,) for x in signed], "bits long"), limit, block_rows=5).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((prints[at[r.a]] ^ prints[at[r.b]]) >= 0 for r in found)
    low = list(range(len(prints)))
    for _ in prints:
        for r in found:
            least = min(low[at[r.a]], low[at[r.b]])
            low[at[r.a]] = low[at[r.b]] = least
    assert low == [want[i] for i in range(len(prints))]


def test_documents(spark, rows):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("Ab cd éé EF gh ij kl mn".split()) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += [t + " zz" for t in texts[:20]] + texts[:10] + ["", None, " \t\n", "x", "X y", "w " * 20000]
    data = [(i, t, "clash") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(rows(data, "doc_id long, text string, bits string"), block_rows=4).collect()
    prints = [(i, plain_fingerprint(t, 4)) for i, t in enumerate(texts)]
    low = plain_components(prints, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", low[i]) for i, x in prints}
    assert len(got) == len(texts)


def test_one_of_each_group_stays(rows):
    text = " ".join(f"w{i}" for i in range(50))
    data = [(3, text, 1), (1, text, 2), (1, text, 3), (2, "other words", 4), (None, text, 5), (9, None, 6)]
    kept = simhash.one_per_group(rows(data, "doc_id long, text string, rows int")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 9), (True, 0)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "rows"}


def test_empty_table(rows):
    empty = rows([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.one_per_group(empty).collect() == []


def test_long_chains_and_stars_are_connected(spark):
    from schemalign.llm.components import components

    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.node: r.component for r in components(chain.union(star).union(star)).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1500)}
