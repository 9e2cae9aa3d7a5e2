"""Length buckets against all choices of boundaries."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from schemalign.llm import packing, queries


def padding(counts, ends):
    return sum(n * (min(e for e in ends if e >= length) - length) for length, n in counts.items())


@pytest.mark.parametrize("seed", range(12))
def test_no_choice_pads_less(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(9)}
    buckets = rng.randint(1, 6)
    lengths = sorted(counts)
    got = packing.choose_buckets(np.array(lengths), np.array([counts[x] for x in lengths]), buckets)
    least = min(
        padding(counts, [*some, lengths[-1]])
        for k in range(min(buckets, len(lengths)))
        for some in itertools.combinations(lengths[:-1], k)
    )
    assert got == sorted(set(got)) and len(got) <= buckets and padding(counts, got) == least


def test_batches(rows):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.choice([1, 3, 7, 20, 45])) for _ in range(300)] + ["", None, " \t ", "w " * 1234]
    data = [(i, t, 0) for i, t in enumerate(texts)] + [(7, texts[7], 0)] + [(None, "a b", 0)]
    got = packing.pack(rows(data, "doc_id long, text string, bucket int"), max_tokens=50, buckets=3, batch_tokens=100, shard_rows=10).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        assert r.n_tokens <= 50 and (r.n_tokens == 0) == (r.bucket is None)
    want = Counter()
    for i, t, _ in data:
        want[i] += len((t or "").split())
    assert tokens == want
    by_bucket = defaultdict(list)
    for r in got:
        if r.bucket is not None:
            by_bucket[r.bucket, r.padded_to].append((r.batch, r.slot))
    ends = sorted(e for _, e in by_bucket)
    assert len(by_bucket) == 3
    for (bucket, end), places in by_bucket.items():
        slots = max(1, 100 // end)
        assert ends[bucket] == end and sorted(places) == [divmod(k, slots) for k in range(len(places))]
    assert all(r.padded_to == min(e for e in ends if e >= r.n_tokens) for r in got if r.bucket is not None)


def test_empty_table(rows):
    assert packing.pack(rows([], "doc_id long, text string")).collect() == []


def test_query_packs_ids(spark, rows, tmp_path):
    untouched = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    texts = ["the house", "漢字" * 3000, "A1b2/+" * 2000, "x\n\n y  z ", "", None, "a<|endoftext|>b", "Straße, naïveté."]
    rows(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_length_buckets(spark, str(tmp_path)).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        assert r.n_tokens <= packing.MAX_TOKENS
    assert tokens == Counter({i: len(untouched.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)})
    assert max(r.piece for r in got if r.doc_id == 1) > 0
