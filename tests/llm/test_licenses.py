"""Licence paragraphs planted among other text."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from schemalign.llm import licenses

PLANTED = {
    1: (1, "Released under the MIT License.", "MIT"),
    2: (0, "LICENSED under the Apache License, Version 2.0!", "Apache"),
    3: (2, "This work is licensed under the GNU General Public License, version 2.", "GPL"),
    4: (1, "Licensed under CC BY-NC 3.0.", "CC-BY-NC"),
    5: (0, "Redistribution and use in source and binary forms, with or without modification, are permitted provided", "BSD"),
}


def test_scan(rows):
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice("the of and river stone paper under version walk seven public bright".split()) for _ in range(12))
    docs = []
    for k in range(200):
        lines = [filler() for _ in range(rng.randint(2, 6))]
        if k in PLANTED:
            lines[PLANTED[k][0] : PLANTED[k][0]] = [PLANTED[k][1]]
        docs.append((k, "\n".join(lines)))
    docs += [(300, None), (301, ""), (302, "\n\n"), (303, "word " * 20_000), (None, PLANTED[1][1]), (1, docs[1][1]), (304, "A driving license is required.")]
    found = licenses.scan(rows([(*d, 1) for d in docs], "doc_id long, text string, paragraph int"))
    got = [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in found.collect()]
    want = [(k, at, family, True) for k, (at, _, family) in PLANTED.items()] + [(None, 0, "MIT", True), (1, 1, "MIT", True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_anchors_lose_nothing(rows):
    docs = rows([(k, t) for k, (_, t, _) in PLANTED.items()] + [(9, "nothing here")], "doc_id long, text string")
    model = licenses.train(docs)
    every = licenses._probabilities(licenses.paragraphs(docs), model).filter("family <> 'unknown'").count()
    some = licenses._probabilities(licenses.paragraphs(docs, model.anchors), model).filter("family <> 'unknown'").count()
    assert every == some == 5


def test_empty_table(rows):
    assert licenses.scan(rows([], "doc_id long, text string")).collect() == []


def test_wrapped_notices(rows):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    narrow = "Permission is hereby\ngranted, free of\ncharge, to any\nperson obtaining a\ncopy of this\nsoftware"
    apart = gpl.replace("\n", "\n\n")
    docs = [(k, f"river stone {k}\npaper walk") for k in range(100)]
    docs += [(200, gpl), (201, "river stone\n\n" + gpl + "\n\nwalk"), (202, narrow), (203, apart), (200, gpl)]
    found = licenses.scan(rows(docs, "doc_id long, text string")).filter("confirmed").collect()
    got = sorted((r.doc_id, r.paragraph, r.family) for r in found)
    assert got[:3] == [(200, 0, "GPL"), (200, 0, "GPL"), (201, 2, "GPL")]
    assert {(d, f) for d, _, f in got[3:]} == {(202, "MIT")}


NOTICES = {
    "LGPL": "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see the site.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.",
    "CC-BY-ND": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided",
    "GPL": "This work is licensed under the GNU General Public License, version 2.",
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY": "Licensed under CC BY 4.0.",
}
REFUSED = (
    "This project is not licensed under the terms of the MIT license.",
    "This project is no longer licensed under the terms of the MIT license.",
    "This work was never licensed under the GNU General Public License, version 3.",
    "Licensed under the Foo Apache Mozilla License, Version 2.0.",
)


def _filler(n):
    rng = random.Random(9)
    return [(k, "\n".join(" ".join(rng.choice("the of and river stone paper under version walk seven public bright work not".split()) for _ in range(12)) for _ in range(3))) for k in range(n)]


def test_families_alike_and_denials(rows):
    docs = _filler(150) + [(1000 + k, t) for k, t in enumerate(NOTICES.values())] + [(2000 + k, t) for k, t in enumerate(REFUSED)]
    found = licenses.scan(rows(docs, "doc_id long, text string")).filter("confirmed").collect()
    assert sorted((r.doc_id, r.family) for r in found) == [(1000 + k, family) for k, family in enumerate(NOTICES)]


def _plain_scan(docs, model):
    """Every line by itself: the regression, the templates and the words by hand."""
    import math
    import re

    def words_of(text):
        return [w for w in re.split(r"[\W_]+", text.lower()) if w]

    def pairs(words):
        return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}

    place = {g: k for k, g in enumerate(model.vocabulary)}
    weights, intercepts = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    out = []
    for doc_id, text in docs:
        for at, line in enumerate(text.split("\n")):
            words = words_of(line)
            at_grams = [place[g] for g in {*words, *pairs(words)} if g in place]
            told = intercepts + weights[:, at_grams].sum(axis=1)
            chances = [1 / sum(math.exp(u - t) for u in told) for t in told]
            best = max(range(len(told)), key=lambda k: chances[k])
            family = model.families[best]
            if family == licenses.UNKNOWN or chances[best] < model.bound or not words:
                continue
            share = max(len(pairs(words_of(t)) & pairs(words)) / len(pairs(words_of(t))) for t in licenses.TEMPLATES[family])
            denied = any(w in licenses.DENIALS and set(words[k + 1 : k + 4]) & set(licenses.GRANTS) for k, w in enumerate(words))
            told_words = {*words, *pairs(words)}
            foreign = any(w in licenses.MARKS and family not in licenses.MARKS[w] for w in told_words)
            lacking = any(not set(kind) & told_words for kind in licenses.NEEDED.get(family, ()))
            out.append((doc_id, at, family, share >= licenses.TEMPLATE_SHARE and not (denied or foreign or lacking)))
    return sorted(out)


def test_against_every_line_by_hand(rows):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rng = random.Random(6)
    docs = _filler(60)
    for k in range(120):
        words = rng.choice([*lines, *REFUSED]).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["not", "river", "Apache", "BY-NC", "under", "the"])
        docs.append((500 + k, f"river stone\n\n{' '.join(words)}\n\nwalk"))
    df = rows(docs, "doc_id long, text string")
    model = licenses.train(df)
    got = sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan(df, model).collect())
    want = _plain_scan(docs, model)
    assert got == want and sum(r[3] for r in want) > 40


def test_the_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(_filler(300), "doc_id long, text string")
    models = [licenses.train(docs.repartition(n), 200) for n in (1, 7)]
    assert models[0].bound == models[1].bound
    assert abs(models[0].regression.coefficientMatrix.toArray() - models[1].regression.coefficientMatrix.toArray()).max() < 1e-6


def test_every_paragraph_counts_in_the_background(spark):
    filler = [(k, f"plain line {k}\nthe software of town {k % 7} is free") for k in range(300)]
    docs = spark.createDataFrame([*filler, *filler[:50], (900, None), (901, " \n")], "doc_id long, text string")
    vocabulary = licenses._vocabulary(spark)
    weights = [r["weight"] for r in licenses._background(docs, vocabulary).collect()]
    assert sum(weights) == 307  # distinct paragraphs, however many rows the fit is to weigh
    models = [licenses.train(d, 20) for d in (docs, docs.repartition(5))]
    assert models[0].bound == models[1].bound


def test_lines_are_cut_into_words_once(spark):
    docs = spark.createDataFrame([(1, "a stone\nReleased under the MIT License.\n")], "doc_id long, text string")
    for made in (licenses._wrapped(docs, ["mit", "license"]), licenses.paragraphs(docs, ["mit", "license"])):
        assert made._jdf.queryExecution().executedPlan().toString().count("split(lower(") == 1


def test_templates_are_one_constant(spark):
    """Code that grew with the templates took gigabytes of an executor to compile."""
    texts = ["mit license mit license under the mit license", "eclipse public license version 2 0", "licensed under cc by sa 4 0", "a b", ""]
    rows = licenses._word_pairs(spark.createDataFrame([(t.split(),) for t in texts], "words array<string>"))
    kinds = [rows.crossJoin(spark.createDataFrame([(f,)], "family string")) for f in (*licenses.TEMPLATES, licenses.UNKNOWN)]
    for named in kinds:
        made = named.withColumn("share", licenses.template_share(named["family"])).withColumn("alike", licenses._held_by_any(0.3))
        told = made.withColumn("confirmed", licenses.confirmed(named["family"], made["share"]))
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert plan.count("array_intersect(") <= 3 and plan.count("arrays_overlap(") <= 4
    for r in kinds[0].unionByName(kinds[7]).unionByName(kinds[-1]).withColumn("share", licenses.template_share(F.col("family"))).collect():
        plain = [[tuple(p.split()) for p in licenses._pairs_of(t)] for t in licenses.TEMPLATES.get(r.family, ())]
        own = set(zip(r.words, r.words[1:], strict=False))
        assert r.share == max([len(own.intersection(t)) / len(t) for t in plain], default=0.0)
