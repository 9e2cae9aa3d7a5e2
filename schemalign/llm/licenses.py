"""Licence scan: a trained paragraph classifier whose findings templates confirm.

A paragraph is a line of a text, with the lines after it up to one without words where a notice is wrapped. Words and
pairs of neighbouring words are the features of a multinomial logistic regression over licence families and a class of
its own for everything else. A family counts as predicted where its probability reaches a bound that is calibrated on
paragraphs of no licence. It is confirmed where the paragraph also holds enough of one of the family's templates, has the
words that tell the family from its like and none that tell another one, and is not denied. Everything is DataFrame
expressions and Spark's own regression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemalign.operators.settle import settle

UNKNOWN = "unknown"

# Templates of the families, short notices as they stand in texts and openings of the licences themselves.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-NC-SA": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "Proprietary": (
        "Copyright. All rights reserved. No part of this work may be reproduced without written permission.",
        "This document is confidential and proprietary. All rights reserved.",
    ),
}

# Words and pairs that tell families apart, by those that have them. A paragraph with one that its family
# has not is not confirmed, nor is one that lacks a kind its family needs.
MARKS = {
    "lesser": ("LGPL",), "lgpl": ("LGPL",), "affero": ("AGPL",), "agpl": ("AGPL",), "mozilla": ("MPL",), "mpl": ("MPL",),
    "eclipse": ("EPL",), "epl": ("EPL",), "apache": ("Apache",), "isc": ("ISC",), "bsd": ("BSD",), "mit license": ("MIT",),
    "sharealike": ("CC-BY-SA", "CC-BY-NC-SA"), "by sa": ("CC-BY-SA",), "nc sa": ("CC-BY-NC-SA",),
    "noderivatives": ("CC-BY-ND", "CC-BY-NC-ND"), "noderivs": ("CC-BY-ND", "CC-BY-NC-ND"), "by nd": ("CC-BY-ND",), "nc nd": ("CC-BY-NC-ND",),
    "noncommercial": ("CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-ND"), "by nc": ("CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-ND"),
}
NEEDED = {
    "LGPL": (("lesser", "lgpl"),), "AGPL": (("affero", "agpl"),), "CC-BY-SA": (("sharealike", "by sa"),),
    "CC-BY-ND": (("noderivatives", "noderivs", "by nd"),), "CC-BY-NC": (("noncommercial", "by nc"),),
    "CC-BY-NC-SA": (("noncommercial", "by nc"), ("sharealike", "nc sa")),
    "CC-BY-NC-ND": (("noncommercial", "by nc"), ("noderivatives", "noderivs", "nc nd")),
}

# A word of denial so few words before one of granting takes the notice back.
DENIALS = ("not", "never", "isn", "wasn", "aren", "neither", "nor", "longer")
GRANTS = ("licensed", "released", "distributed", "available", "subject", "governed", "permitted", "granted", "covered", "published", "under")
DENIAL_REACH = 3

# Sentences with the same words that declare no licence.
NO_LICENCE = (
    "A driving license is required to rent a car.",
    "The doctor lost her license to practice.",
    "See the license file for details.",
    "The software was released in the spring and distributed to the public.",
    "He works for the general public and needs permission to use this copy of the file.",
    "Under the terms of the agreement the work was reserved for the author.",
    "The version under development uses a modified source and a binary form.",
    "You may not use this file.",
    "License.",
    "Apache helicopters flew over the eclipse and a lesser crowd of Mozilla fans.",
    "She studied at MIT and writes about attribution in creative work.",
    "The eclipse was covered by public television, version and source unknown.",
)

STOP_WORDS = "a an and any are as at be been by can for found from had has have he her in is it its may new no not of on or that the this to was which will with you".split()

VARIANTS = 24
BACKGROUND_ROWS = 4000
MISTAKES_ALLOWED = 0.001
TEMPLATE_SHARE = 0.6
SEED = 5


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty one stands at an end that has none."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _features(rows: DataFrame) -> DataFrame:
    """(words) -> and grams: words that tell something, and pairs that hold one of them."""
    telling = F.filter("words", lambda w: ~w.isin(STOP_WORDS))
    following = lambda i: F.get("words", i + 1)
    pair = lambda w, i: F.when(~w.isin(STOP_WORDS) | ~following(i).isin(STOP_WORDS), F.concat_ws(" ", w, following(i)))
    firsts = F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.filter(F.transform(firsts, pair), lambda g: g.isNotNull())
    return rows.withColumn("grams", F.array_distinct(F.concat(telling, pairs)))


def _holds_any(words: Column | str, listed: list[str]) -> Column:
    """Whether one of the words is listed: one look for each word, however long the list."""
    return F.exists(words, lambda w: w.isin(listed))


def paragraphs(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, paragraph, words): the lines of the texts, counted from 0, with words.

    With anchors, only lines that hold one of these words; the others have no feature at all, so nothing is lost.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    told = lines.select("doc_id", "paragraph", _once(words(F.col("line"))).alias("words"))
    if anchors is not None:
        told = told.filter(_holds_any("words", anchors))
    return told.select("doc_id", "paragraph", F.array_remove("words", "").alias("words")).filter(F.size("words") > 0)


# A wrapped notice that begins in a line has at most so many words in it and after it.
REACH = max(len(t.split()) for ts in TEMPLATES.values() for t in ts) + 4


def _wrapped(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, paragraph, end, rest): lines that another line with words follows.

    end are the line's last words, rest the first words of the lines after it up to one without words, REACH at most of
    each. Only lines that hold one of the anchors or stand before a line that does.
    """
    several = docs.filter(F.contains("text", F.lit("\n")))
    told = several.select("doc_id", _once(F.transform(F.split("text", "\n"), lambda x: F.array_remove(words(x), ""))).alias("lines"))
    marked = told.select("*", _once(F.transform("lines", lambda w: _holds_any(w, anchors))).alias("marked"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 2),
        lambda i: (F.size(F.get("lines", i)) > 0) & (F.size(F.get("lines", i + 1)) > 0) & (F.get("marked", i) | F.get("marked", i + 1)),
    )
    cut = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("paragraph"),
            F.slice(F.get("lines", i), F.greatest(F.size(F.get("lines", i)) - REACH + 1, F.lit(1)), REACH).alias("end"),
            F.transform(F.slice("lines", i + 2, REACH), lambda w: F.slice(w, 1, REACH)).alias("after"),
        ),
    )
    found = marked.filter(F.array_contains("marked", True)).select("doc_id", F.explode(cut).alias("at")).select("doc_id", "at.*")
    blank = F.array_position(F.transform("after", lambda w: F.size(w) == 0), True)
    held = F.when(blank > 0, F.slice("after", 1, (blank - 1).cast("int"))).otherwise(F.col("after"))
    return found.select("doc_id", "paragraph", "end", F.slice(F.flatten(held), 1, REACH).alias("rest"))


def _examples(spark: SparkSession) -> DataFrame:
    """(family, words): every template whole and with words left out here and there."""
    labelled = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in NO_LICENCE]
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in labelled])).alias("r")
    every = spark.range(VARIANTS).select("id", rows).select("id", "r.family", F.array_remove(words(F.col("r.text")), "").alias("words"))
    kept = F.filter("words", lambda w, i: (F.col("id") == 0) | (F.pmod(F.xxhash64(F.lit(SEED), "id", w, i), F.lit(8)) > 0))
    return every.select("family", kept.alias("words"))


def _vocabulary(spark: SparkSession) -> list[str]:
    """The grams of the templates: a fixed list of a few hundred."""
    families = _features(_examples(spark)).filter(F.col("family") != UNKNOWN)
    return [r["g"] for r in families.select(F.explode("grams").alias("g")).distinct().orderBy("g").collect()]


@dataclass
class Model:
    vocabulary: list[str]
    families: list[str]
    vectors: CountVectorizerModel
    regression: LogisticRegressionModel
    bound: float

    @property
    def anchors(self) -> list[str]:
        return _anchors(self.vocabulary)


def _anchors(vocabulary: list[str]) -> list[str]:
    return sorted({w for g in vocabulary for w in g.split(" ")} - set(STOP_WORDS))


def _probabilities(rows: DataFrame, model: Model) -> DataFrame:
    """rows (words, ...) -> and family, probability: the likeliest class of each."""
    known = F.filter("grams", lambda g: g.isin(model.vocabulary))
    featured = _features(rows).select(*rows.columns, _once(known).alias("grams"))
    return _likeliest(featured, model).select(*rows.columns, "family", "probability")


def _likeliest(featured: DataFrame, model: Model) -> DataFrame:
    """featured (grams, ...) -> and family, probability."""
    seen = model.regression.transform(model.vectors.transform(featured))
    chances = vector_to_array("chances")
    best = F.array_max(F.transform(chances, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    named = F.get(F.array(*map(F.lit, model.families)), -F.col("best.i"))
    return (
        seen.withColumn("best", best)
        .withColumn("family", named)
        .withColumn("probability", F.col("best.p"))
        .select(*featured.columns, "family", "probability")
    )


_PAIRS = "transform(slice(words, 1, greatest(size(words) - 1, 0)), (w, i) -> concat_ws(' ', w, get(words, i + 1)))"


def _word_pairs(rows: DataFrame) -> DataFrame:
    """(words) -> and pairs: each word with the next."""
    return rows.select(*[c for c in rows.columns if c != "pairs"], _once(F.array_distinct(F.expr(_PAIRS))).alias("pairs"))


def _naming_pairs() -> set[str]:
    """Pairs of neighbouring words that name a licence."""
    marks = {f"{mark} {word}" for mark in (*MARKS, "mit") if " " not in mark for word in ("license", "licence", "public", "general")}
    return marks | {"general public", "public license", "creative commons", "cc by", "rights reserved"}


def _listed(names: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def _by_family(values: dict[str, Column], family: Column) -> Column:
    """The family's value, null for one without: the values are one constant, not a branch of code for each family."""
    return F.try_element_at(F.create_map(*[c for name, value in values.items() for c in (F.lit(name), value)]), family)


def confirmed(family: Column, share: Column) -> Column:
    """Whether a paragraph (words) of the family that holds such a share of a template declares that licence."""
    told = F.concat("words", F.expr(_PAIRS))
    others = {name: _listed(sorted(m for m, of in MARKS.items() if name not in of)) for name in TEMPLATES}
    kinds = {name: F.array(*map(_listed, of)) for name, of in NEEDED.items()}
    foreign = F.arrays_overlap(told, _by_family(others, family))
    lacking = F.exists(_by_family(kinds, family), lambda kind: ~F.arrays_overlap(told, kind))
    no = F.lit(False)
    return (share >= TEMPLATE_SHARE) & ~F.coalesce(foreign, no) & ~F.coalesce(lacking, no) & ~_denied()


def _denied() -> Column:
    """Whether a word of denial stands just before one of granting."""
    denial, grant = F.array(*map(F.lit, DENIALS)), F.array(*map(F.lit, GRANTS))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(denial, w), i + 2)), lambda i: i.isNotNull())
    return F.exists(places, lambda i: F.arrays_overlap(F.slice("words", i, DENIAL_REACH), grant))


def _pairs_of(template: str) -> list[str]:
    plain = "".join(c if c.isalnum() else " " for c in template.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(plain, plain[1:], strict=False)})


def _templates() -> Column:
    """(family, pairs) of every template, as one constant: an expression on each would be code that grows with them."""
    return F.array(*[F.struct(F.lit(name).alias("family"), _listed(_pairs_of(t)).alias("pairs")) for name, ts in TEMPLATES.items() for t in ts])


def _held(template: Column) -> Column:
    """The share of a template's word pairs that a paragraph's pairs hold."""
    return F.size(F.array_intersect(template["pairs"], F.col("pairs"))) / F.size(template["pairs"])


def _with_template_pairs(rows: DataFrame) -> DataFrame:
    """Of the rows' pairs those that stand in a template."""
    listed = sorted({p for ts in TEMPLATES.values() for t in ts for p in _pairs_of(t)})
    rest = [c for c in rows.columns if c != "pairs"]
    return rows.select(*rest, _once(F.filter("pairs", lambda p: p.isin(listed))).alias("pairs"))


def _held_by_any(share: float) -> Column:
    """Whether the pairs hold so much of some template; most rows have too few pairs for any."""
    least = min(math.ceil(share * len(_pairs_of(t))) for ts in TEMPLATES.values() for t in ts)
    return (F.size("pairs") >= least) & F.exists(_templates(), lambda t: _held(t) >= share)


def _once(value: Column) -> Column:
    """value behind a generator, so that no expression on it computes it again for every element of a lambda."""
    return F.explode(F.array(value))


def template_share(family: Column) -> Column:
    """The largest share of _held among the templates of the family in question."""
    return F.greatest(F.lit(0.0), F.array_max(F.transform(F.filter(_templates(), lambda t: t["family"] == family), _held)))


def train(docs: DataFrame, background_rows: int = BACKGROUND_ROWS) -> Model:
    """Fit on the templates, the sentences that declare nothing, and all distinct paragraphs of docs: the background.

    Paragraphs that hold a template's pairs or name a licence are no background. Half of it, by hash, trains the unknown
    class; the other half sets the bound: at most one in a thousand of it may pass it. Paragraphs with the same features
    are one row that counts as many times; together they weigh as much as background_rows rows at most, so that a large
    background does not outweigh the templates. Paragraphs are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    vocabulary = _vocabulary(spark)
    families = [*TEMPLATES, UNKNOWN]
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    background = settle(_background(docs, vocabulary))
    total = background.agg(F.sum("weight").alias("n")).first()["n"] or 0
    scaled = F.col("weight") * min(1.0, background_rows / max(total, 1))
    place = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    examples = _features(_examples(spark)).select("family", "grams", F.lit(1.0).alias("weight"))
    half = background.filter("half = 0").select(F.lit(UNKNOWN).alias("family"), "grams", scaled.alias("weight"))
    rows = settle(examples.unionByName(half).withColumn("label", place.cast("double")))
    regression = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60, probabilityCol="chances", weightCol="weight")
    model = Model(vocabulary, families, vectors, regression.fit(vectors.transform(rows)), 0.5)
    seen = settle(_likeliest(background.filter("half = 1"), model)).filter(F.col("family") != UNKNOWN)
    # As many times as there are paragraphs with these features.
    known = seen.select("probability", F.explode(F.sequence(F.lit(1), F.col("weight").cast("long"))))
    reached = F.percentile_approx("probability", 1 - MISTAKES_ALLOWED, 10_000)
    worst = known.agg(reached.alias("p")).first()["p"]
    model.bound = max(0.5, worst or 0.0)
    return model


def _background(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(half, grams, weight): the features of the distinct paragraphs that are no licence's, and how many have them."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    told = lines.select(_once(F.array_remove(words(F.col("line")), "")).alias("words")).filter(F.size("words") > 0)
    # Paragraphs without an anchor have no feature; only how many they are counts.
    marked = told.select(F.xxhash64("words").alias("id"), F.when(_holds_any("words", _anchors(vocabulary)), F.col("words")).alias("words"))
    once = settle(marked.distinct())
    half = F.pmod("id", F.lit(2)).alias("half")
    plain = once.filter("words IS NULL").select("id", F.array().cast("array<string>").alias("grams"))
    some = _word_pairs(once.filter("words IS NOT NULL")).filter(~_holds_any("pairs", sorted(_naming_pairs())))
    unlike = _features(_with_template_pairs(some).filter(~_held_by_any(TEMPLATE_SHARE / 2)))
    known = F.array_sort(F.filter("grams", lambda g: g.isin(vocabulary)))
    every = plain.unionByName(unlike.select("id", known.alias("grams")))
    return every.groupBy(half, "grams").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _wrapped_findings(docs: DataFrame, model: Model) -> DataFrame:
    """The findings of scan that more than one line is needed for: confirmed neither by the line nor by those after it."""
    wrapped = _wrapped(docs, model.anchors)
    both = _word_pairs(wrapped.select("*", _once(F.concat("end", "rest")).alias("words")))
    alike = settle(_with_template_pairs(both).filter(_held_by_any(TEMPLATE_SHARE)).drop("pairs"))
    likely = settle(_probabilities(alike, model)).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= model.bound))
    whole = _word_pairs(likely).withColumn("template_share", F.round(template_share(F.col("family")), 4))
    for part in ("end", "rest"):
        alone = _word_pairs(whole.drop("pairs").withColumn("words", F.col(part)))
        whole = alone.withColumn(f"{part}_share", template_share(F.col("family")))
    needed = (F.col("template_share") >= TEMPLATE_SHARE) & (F.col("end_share") < TEMPLATE_SHARE) & (F.col("rest_share") < TEMPLATE_SHARE)
    both = whole.filter(needed).withColumn("words", F.concat("end", "rest"))
    return both.select("doc_id", "paragraph", "words", "family", "probability", "template_share")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, paragraph, family, probability, template_share, confirmed).

    One row per paragraph in which a family is predicted, whole texts being read. confirmed says that the paragraph holds
    at least TEMPLATE_SHARE of the word pairs of one of the family's templates and that nothing in it speaks against the
    family. A notice wrapped over lines is a further row at the line it begins in. Paragraphs with an anchor word, and
    their predictions, are written to the shared folder, so that nothing is computed over again for each word or filter.
    Null and empty texts have no paragraphs; repeated rows are scanned repeatedly; other columns are not looked at.
    """
    model = model or train(docs)
    candidates = settle(paragraphs(docs, model.anchors))
    found = settle(_probabilities(candidates, model))
    likely = found.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= model.bound))
    shared = template_share(F.col("family"))
    single = _word_pairs(likely).withColumn("template_share", F.round(shared, 4))
    columns = ["doc_id", "paragraph", "words", "family", "probability", "template_share"]
    return single.select(*columns).unionByName(_wrapped_findings(docs, model)).select(
        "doc_id",
        "paragraph",
        "family",
        F.round("probability", 4).alias("probability"),
        "template_share",
        confirmed(F.col("family"), F.col("template_share")).alias("confirmed"),
    )
