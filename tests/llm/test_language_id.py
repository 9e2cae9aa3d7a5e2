"""Language ID: evidence against a plain computation, odd inputs, clean documents kept."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from schemalign.llm import language_id as li

SAMPLES = {
    "de": "der die das und nicht eine schule straße über haus garten wirklich zwischen", "en": "the and with house garden between really school street over this thing",
    "es": "el la los casa jardín entre escuela calle sobre esta cosa niño señor", "fr": "le la les maison jardin entre école rue dessus cette chose garçon être",
}


def corpus(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SAMPLES))
        text = " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(rng.randint(3, 40)))
        rows.append((k, text, lang if rng.random() < 0.9 else rng.choice(["xx", None, "en"]), f"host{k % 3}"))
    return rows


def plain(rows, tables, n=4):
    """The sum of the evidence row by row; rows are (key, text, declared, suffix, host, domain)."""
    names = ["de", "en", "es", "fr"]
    likely = [tables.astype(np.float32)[li.trigram_slots(r[1])].sum(axis=0, dtype=float) for r in rows]
    sizes = [len(li.trigram_slots(r[1])) for r in rows]
    says = [int(np.argmax(v)) if s else None for v, s in zip(likely, sizes, strict=True)]
    value = lambda r, c: r[c] or ""
    total = [says.count(k) for k in range(n)]
    count = lambda c, v, k, same=None: sum(s == k and value(r, c) == v for r, s in zip(rows, says, strict=True))
    result = {}
    for r, v, size, own in zip(rows, likely, sizes, says, strict=True):
        told = []
        for k in range(n):
            t = min(1, li.EFFECTIVE / max(size, 1)) * v[k]
            for c in (2, 3):
                kinds = len({value(x, c) for x in rows})
                t += math.log((count(c, value(r, c), k) + 1) / (total[k] + kinds))
            prior = [(total[j] + 1) / (sum(total) + n) for j in range(n)]
            for c in (5, 4):
                held = [sum(s == j and value(x, c) == value(r, c) and (c == 5 or value(x, 5) == value(r, 5)) for x, s in zip(rows, says, strict=True)) - (own == j) for j in range(n)]
                prior = [(h + li.HOST_WEIGHT * p) / (sum(held) + li.HOST_WEIGHT) for h, p in zip(held, prior, strict=True)]
            told.append(t + math.log(prior[k]))
        best = int(np.argmax(told))
        result[r[0]] = names[best] if size else li.UNDETERMINED
    return result


def test_against_plain_sums(rows):
    data = [(k, t, d, "com/fr" if k % 7 == 0 else None, h, "one" if h != "host2" else "two") for k, t, d, h in corpus(1, 120)]
    data += [(500, None, "en", None, None, None), (501, "123 !", "de", None, "host1", "one"), (502, "", None, None, None, None)]
    df = rows(data, "key long, text string, declared string, suffix string, host string, domain string")
    known = li.profiles(df, sorted(SAMPLES))
    got = {r.key: r.language for r in li.identify(df, known=known).collect()}
    assert got == plain(data, known.tables)


def test_documents(rows):
    data = [(k, t, d, h, 1) for k, t, d, h in corpus(2)]
    odd = [(900, None, "en", "host0", 1), (901, "", None, None, 1), (902, "12 + 34 = 46", "en", "host1", 1), (903, "ѳѳѳ ѵѵѵ ѡѡѡ ѫѫѫ ѯѯѯ ѱѱѱ " * 9, None, "host1", 1), (None, "the house and the garden", None, None, 1), (3, data[3][1], data[3][2], data[3][3], 1)]
    df = rows(data + odd, "doc_id long, text string, lang string, source string, key int")
    kept = li.in_a_language(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(i for i in ids if i is not None) == sorted([*range(200), 3, 903]) and ids.count(None) == 1
    ev = li.document_evidence(df)
    right = {(r.row, r.row2): r.language for r in li.identify(ev).collect()}
    truth = {(r.row, r.row2): r.doc_id for r in df.select(*li._row_key(df), "doc_id").collect()}
    rng = random.Random(2)
    langs = {}
    for k in range(200):
        langs[k] = rng.choice(list(SAMPLES))
        [rng.choice(SAMPLES[langs[k]].split()) for _ in range(rng.randint(3, 40))]
        if rng.random() >= 0.9:
            rng.choice(["xx", None, "en"])
    hit = [right[key] == langs[i] for key, i in truth.items() if i is not None and i < 200]
    assert np.mean(hit) > 0.97


def test_pages(rows):
    page = '<!DOCTYPE html><HTML class="x" lang=\'fr\'><script>the and with</script><!-- the --><p>les maison &eacute;cole</p>'
    df = rows([(1, "https://M.example.com/fr/3?x", page), (2, None, None)], "page_id long, url string, html string")
    got = {r.key: r for r in li.page_evidence(df).collect()}
    assert (got[1].declared, got[1].suffix, got[1].host, got[1].domain) == ("fr", "com/fr", "m.example.com", "example.com")
    assert li.page_text(page).split() == ["les", "maison", "école"]
    assert {r.key: r.language for r in li.identify(li.page_evidence(df), sorted(SAMPLES), markup=True).collect()} == {1: "fr", 2: "und"}


@pytest.mark.parametrize("text,n", [("", 0), ("..", 0), ("a", 1), ("Ab cd", 5), ("a  1 b", 3), ("ß\U0001d400", 2)])
def test_trigrams(text, n):
    assert len(li.trigram_slots(text)) == n


def test_empty_table(rows):
    df = rows([], "doc_id long, text string, lang string, source string")
    assert li.in_a_language(df).collect() == []


MORE = {
    "it": "il la gli casa giardino tra scuola strada sopra questa cosa ragazzo perché essere",
    "ru": "и в не на дом сад между школа улица над эта вещь мальчик",
    "zh": "的 一 是 不 了 人 我 在 有 他 这 中 大 来 上 国",
    "ar": "في من على هذا البيت المدرسة الشارع الولد الحديقة بين",
}


def test_every_declared_language_has_a_profile(rows):
    rng = random.Random(7)
    data = corpus(3)
    for name, words in MORE.items():
        data += [(1000 + len(data), " ".join(rng.choice(words.split()) for _ in range(rng.randint(5, 40))), name, "host0") for _ in range(30)]
    df = rows(data, "doc_id long, text string, lang string, source string")
    assert li.languages_of(li.document_evidence(df)) == sorted([*SAMPLES, *MORE])
    assert li.in_a_language(df).count() == len(data)
    found = {(r.row, r.row2): r.language for r in li.identify(li.document_evidence(df)).collect()}
    told = df.select(*li._row_key(df), "doc_id", "lang").filter("doc_id >= 1000").collect()
    assert np.mean([found[r.row, r.row2] == r.lang for r in told]) > 0.97


def test_languages_without_a_profile_are_kept(rows):
    rng = random.Random(7)
    few = [(2000 + k, " ".join(rng.choice(words.split()) for _ in range(30)), name, "host0") for k, (name, words) in enumerate(MORE.items())]
    data = corpus(3) + few + [(3000, "12 - 13", "ru", "host0")]
    df = rows(data, "doc_id long, text string, lang string, source string")
    assert li.languages_of(li.document_evidence(df)) == sorted(SAMPLES)
    assert {r.doc_id for r in li.in_a_language(df).collect()} == {d[0] for d in data} - {3000}
    found = {(r.row, r.row2): r.language for r in li.identify(li.document_evidence(df)).collect()}
    told = {r.doc_id: found[r.row, r.row2] for r in df.select(*li._row_key(df), "doc_id").collect()}
    assert [told[k] for k in (2001, 2002, 2003, 3000)] == [li.OTHER, li.OTHER, li.OTHER, li.UNDETERMINED]


def test_no_language_is_declared(rows):
    df = rows([(1, "the house", None, None), (2, "…", "", "s")], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in li.in_a_language(df).collect()] == [1]
