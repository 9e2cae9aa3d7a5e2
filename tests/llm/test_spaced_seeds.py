"""Decontamination against comparing every document with every item."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from schemalign.llm import spaced_seeds


def plain(docs, items, window=20, identity=0.8):
    """(doc_id, item_id) pairs by trying every diagonal."""
    found = set()
    for doc_id, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for item_id, item in items:
            told = re.findall(r"\w+", (item or "").lower())
            if item_id is None or not told:
                continue
            width = min(window, len(told))
            for line in range(-len(told), len(words) + 1):
                same = [0 <= line + k < len(words) and words[line + k] == w for k, w in enumerate(told)]
                inside = [k for k in range(len(told)) if 0 <= line + k < len(words)]
                if any(sum(same[k : k + width]) >= identity * width for k in inside if k + width <= len(told) and k + width - 1 in inside):
                    found.add((doc_id, item_id))
    return found


@pytest.fixture
def tables(rows):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 60)))) for k in range(20)]
    items += [(20, "one two three four five six"), (21, "too short"), (22, None), (None, items[0][1]), (23, items[1][1])]
    docs = []
    for k in range(60):
        text = [word() for _ in range(rng.randint(0, 150))]
        if k % 3 == 0:
            passage = items[k % 20][1].split()
            for _ in range(rng.randint(0, len(passage) // 8)):
                passage[rng.randrange(len(passage))] = word()
            text[len(text) // 2 : len(text) // 2] = passage
        docs.append((k, ", ".join(text).title() if k % 2 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, "So: one two three four five six."), (103, items[3][1] + " x" * 5000), (None, items[4][1]), (0, docs[0][1])]
    return docs, items, rows([(*d, "c") for d in docs], "doc_id long, text string, row string"), rows(items, "item_id long, text string")


def test_against_every_diagonal(tables):
    docs, items, docs_df, items_df = tables
    want = plain(docs, items)
    got = spaced_seeds.contaminated(docs_df, items_df).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20
    assert len(got) == len(want) + sum(1 for d, _ in want if d == 0)
    kept = spaced_seeds.clean(docs_df, items_df)
    hit = {d for d, _ in want}
    assert sorted((r.doc_id for r in kept.collect())) == sorted(d for d, _ in docs if d not in hit)
    assert kept.columns == ["doc_id", "text", "row"]


def test_empty_tables(rows, tables):
    _, _, docs, items = tables
    none = rows([], "doc_id long, text string")
    no_items = rows([], "item_id long, text string")
    assert spaced_seeds.contaminated(none, items).collect() == []
    assert spaced_seeds.clean(docs, no_items).count() == docs.count()


@pytest.mark.parametrize("n", range(5, 21))
def test_masks_hit_every_pattern(n):
    fits = [{at + k for k, bit in enumerate(m) if bit == "1"} for m in spaced_seeds._masks_for(n) for at in range(n - len(m) + 1)]
    lost = n - min(k for k in range(n + 1) if k >= spaced_seeds.IDENTITY * n)
    assert all(any(not fit & set(places) for fit in fits) for places in itertools.combinations(range(n), lost))
    assert all(len(m) <= spaced_seeds.RUN for m in spaced_seeds._masks_for(n))


def test_many_substitutions(rows):
    rng = random.Random(3)
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in (5, 9, 10, 12, 15, 16, 19, 20, 33)]
    docs = []
    for n, told in items:
        for _ in range(40):
            low = rng.randint(0, max(0, n - 20))
            kept = told[low : low + 20]
            for at in rng.sample(range(len(kept)), len(kept) // 5):
                kept[at] = "other"
            docs.append((len(docs), " ".join(["before", *kept, "after"])))
    texts = [(n, " ".join(told)) for n, told in items]
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.contaminated(rows(docs, "doc_id long, text string"), rows(texts, "item_id long, text string")).collect()}
    assert got == plain(docs, texts) and len(got) == len(docs)


def test_passages_cut_by_an_end(rows):
    told = [f"w{k}" for k in range(40)]
    docs = [(0, " ".join(told[-13:] + ["after"] * 30)), (1, " ".join(["before"] * 30 + told[:13])), (2, " ".join(told[5:17])), (3, " ".join(["x", *told[7:20], "y"] * 2))]
    items = rows([(1, " ".join(told))], "item_id long, text string")
    got = spaced_seeds.contaminated(rows(docs, "doc_id long, text string"), items).collect()
    want = [(0, 1, 0, 27, 13, 13), (1, 1, 30, 0, 13, 13), (3, 1, 1, 7, 13, 13)]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("turned", [False, True])
def test_several_texts_under_one_id(rows, turned):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    items = [(1, a), (1, b), (1, a), (2, b)]
    docs = [(0, f"x {a} y"), (1, f"x {b} y"), (2, f"{b} {a}"), (3, "x y")]
    docs_df = rows(docs, "doc_id long, text string")
    items_df = rows(items[::-1] if turned else items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_start) for r in spaced_seeds.contaminated(docs_df, items_df).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 0), (2, 1, 30), (2, 2, 0)]
    assert [r.doc_id for r in spaced_seeds.clean(docs_df, items_df).collect()] == [3]


def test_short_items_and_scripts_without_blanks(rows):
    items = [(1, "four words are these"), (2, "東京都渋谷区の天気は晴れです"), (3, "Zyzzyva!"), (4, "ภาษาไทยไม่มีช่องว่าง"), (5, "..."), (6, "новости дня сегодня вечером поздно")]
    docs = [(0, "See: four WORDS are these."), (1, "four words were these"), (2, "明日、東京都渋谷区の天気は晴れですね"), (3, "明日東京都渋谷区の天候は晴れです"),
            (4, "a zyzzyva flies"), (5, "zyzzyvas"), (6, "คำภาษาไทยไม่มีช่องว่างครับ"), (7, "... ..."), (8, "новости дня сегодня утром поздно")]
    found = spaced_seeds.contaminated(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 1), (2, 2), (3, 2), (4, 3), (6, 4), (8, 6)]
