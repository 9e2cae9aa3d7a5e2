"""The pipeline over a small corpus, every stage held against a plain version of it."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
import pytest
from test_simhash import plain_components, plain_fingerprint
from test_spaced_seeds import plain as plain_overlaps
from tokenizers import Tokenizer

WORDS = {
    "en": "the and with house garden between really school street over thing walking morning evening river letter winter",
    "fr": "les une maison jardin entre école rue dessus cette chose garçon matin soir rivière lettre hiver être",
}


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("alpha beta gamma delta kappa sigma omega theta lambda zeta".split()) for _ in range(30))) for k in range(4)]
    docs, labels = [], []
    for k in range(240):
        lang = "en" if k % 3 else "fr"
        words = [rng.choice(WORDS[lang].split()) for _ in range(rng.randint(30, 90))]
        toxic = k % 6 == 0
        if toxic:
            for bad in rng.sample(["idiot", "scoundrel", "wretched"], 2):
                words.insert(rng.randrange(len(words)), bad)
        labels.append((k, int(toxic)))
        docs.append([k, " ".join(words), lang, f"src{k % 2}"])
    for k in (10, 11, 13):
        docs[k][1] += " " + items[k % 4][1]
    for k in range(20):
        docs.append([300 + k, docs[k * 7][1], docs[k * 7][2], "src0"])
    docs += [[400, "+++ 1234 ---", "en", "src0"], [401, None, None, None], [402, "", "en", "src1"]]
    for k in range(20):
        words = "il la casa giardino tra scuola strada sopra cosa ragazzo".split() if k % 2 else "дом сад между школа улица над эта вещь мальчик".split()
        docs.append([500 + k, " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(40)), "it" if k % 2 else "ru", "src2"])
    docs.append([600, "これは一つだけの文書です。" * 3, "ja", "src2"])
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]
    folder = tmp_path / "tables"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), docs, items, schema


def test_every_stage(spark, tables, tmp_path):
    folder, docs, items, schema = tables
    text = {i: t for i, t, *_ in docs}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = now
        if name != "packing":
            assert now.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in kept.items()}
    assert ids["language_id"] == sorted(i for i in text if i not in (400, 401, 402))
    bad = ("idiot", "scoundrel", "wretched")
    assert ids["toxicity"] == [i for i in ids["language_id"] if not any(w in text[i].split() for w in bad)]
    low = plain_components([(i, plain_fingerprint(text[i], 4)) for i in ids["toxicity"]], 4)
    assert ids["simhash_near_dedup"] == sorted(i for i in ids["toxicity"] if low[i] == i)
    hit = {d for d, _ in plain_overlaps([(i, text[i]) for i in ids["simhash_near_dedup"]], items)}
    assert hit and ids["decontamination"] == [i for i in ids["simhash_near_dedup"] if i not in hit]
    assert ids["packing"] == ids["decontamination"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in now.collect()} == {i: len(tokenizer.encode(text[i], add_special_tokens=False).ids) for i in ids["decontamination"]}
    assert {*range(500, 520), 600} <= set(ids["decontamination"])
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert whole == sorted(map(tuple, now.collect()))


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "decontamination", "packing"]
