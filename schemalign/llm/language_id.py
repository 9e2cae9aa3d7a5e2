"""Language ID by Bayesian fusion of a text's likelihood with what its source declares.

log P(language | everything) is, up to a constant, the sum of
- the text's log likelihood under the language's trigram profile, weighed as that of EFFECTIVE trigrams at most,
- log P(declared language | language) and log P(address suffix | language), smoothed counts of what the texts say,
- log P(language | host), the host's counts smoothed by its domain's, and those by all rows'; a row's own text is left
  out of its host's counts.
The languages are those that enough rows declare. A class of its own, under which all trigrams are equally likely, takes
texts of no language; those are undetermined, as are texts without letters. A text most of whose letters belong to scripts
that none of the languages is written in cannot be told from noise by their profiles: it is in another language. So is a
text that is like noise and declares a language that has no profile.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.llm.lookups import looked_up, without
from schemalign.llm.url_filter import host_and_path
from schemalign.operators.settle import settle

UNDETERMINED = "und"
OTHER = "other"
# A language has a profile if a twentieth of the rows that declare one, three at least and no more than a hundred, declare
# it; of more than so many languages those declared most, as a profile is a table of SLOTS numbers in every task.
MOST_LANGUAGES = 64
LEAST_ROWS, ENOUGH_ROWS, LEAST_PART = 3, 100, 20
# Scripts by blocks of 128 characters; a block with less than this share of a table's letters is none of its scripts.
BLOCKS, BLOCK_SHARE = 1 << 13, 1e-4
SLOTS = 1 << 16
EFFECTIVE = 200
SMOOTHING = 0.5
HOST_WEIGHT = 10.0
SAID_WEIGHT = 1.0
NOISE_SHARE = 1e-8

_TAGS = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for anything that is no letter."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigram_slots(text: str | None) -> np.ndarray:
    """The text's letter trigrams, as numbers below SLOTS; runs of other characters are one blank."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    chars = _letters()[np.minimum(raw, 0xFFFF)]
    chars = np.concatenate([[32], np.where(raw > 0xFFFF, raw, chars), [32]]).astype(np.uint32)
    chars = chars[np.concatenate([[True], (chars[1:] != 32) | (chars[:-1] != 32)])]
    if len(chars) < 3:
        return np.zeros(0, np.uint32)
    mixed = chars[:-2] * np.uint32(0x9E3779B1) + chars[1:-1] * np.uint32(0x85EBCA6B) + chars[2:] * np.uint32(0xC2B2AE35)
    return mixed >> np.uint32(16)


def page_text(source: str | None) -> str:
    return html.unescape(_TAGS.sub(" ", source or ""))


def letter_blocks(text: str | None) -> np.ndarray:
    """The blocks of 128 characters that the text's letters belong to, one for each letter."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    letters = (raw > 0xFFFF) | (_letters()[np.minimum(raw, 0xFFFF)] != 32)
    return np.minimum(raw[letters] >> np.uint32(7), BLOCKS - 1)


def languages_of(rows: DataFrame) -> list[str]:
    """rows (declared) -> the languages that have a profile, in alphabetical order."""
    counts = settle(rows.filter("declared <> ''").groupBy("declared").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = min(ENOUGH_ROWS, max(LEAST_ROWS, total // LEAST_PART))
    most = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "declared").limit(MOST_LANGUAGES)
    return sorted(r["declared"] for r in most.collect())


@dataclass
class Profiles:
    languages: list[str]
    tables: np.ndarray  # (SLOTS, languages): log probabilities of trigrams
    scripts: np.ndarray  # (BLOCKS,): whether the languages' texts are written in a block


def profiles(rows: DataFrame, languages: Sequence[str] | None = None, markup: bool = False) -> Profiles:
    """rows (text, declared) -> trigram profiles, counted over all rows that declare one of the languages.

    Tasks count first; the sums are SLOTS and BLOCKS numbers per language, whatever the data.
    """
    languages = languages_of(rows) if languages is None else list(languages)
    place = {name: k for k, name in enumerate(languages)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(languages), SLOTS + BLOCKS), np.int64)
        for frame in frames:
            for text, declared in zip(frame["text"], frame["declared"], strict=True):
                if declared in place:
                    text = page_text(text) if markup else text
                    for found in (trigram_slots(text), letter_blocks(text) + SLOTS):
                        slots, n = np.unique(found, return_counts=True)
                        counts[place[declared], slots] += n
        language, slot = np.nonzero(counts)
        yield pd.DataFrame({"language": language, "slot": slot, "n": counts[language, slot]})

    counted = rows.select("text", "declared").mapInPandas(count, "language int, slot int, n long")
    sums = counted.groupBy("language", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((SLOTS + BLOCKS, len(languages)))
    table[sums["slot"], sums["language"]] = sums["n"]
    table, blocks = table[:SLOTS], table[SLOTS:]
    written = (blocks > BLOCK_SHARE * blocks.sum(axis=0)).any(axis=1)
    return Profiles(languages, np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * SLOTS)), written)


def _likelihoods(rows: DataFrame, known: Profiles, markup: bool) -> DataFrame:
    """rows (key..., text, declared, suffix, host, domain) -> the same without text, with trigrams, likely array, foreign.

    foreign: most letters belong to scripts none of the languages is written in.
    """
    sent = rows.sparkSession.sparkContext.broadcast((known.tables.astype(np.float32), known.scripts))
    rest = [c for c in rows.columns if c != "text"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, scripts = sent.value
        for batch in batches:
            sizes, sums, foreign = [], [], []
            for text in batch.column("text").to_pylist():
                text = page_text(text) if markup else text
                slots = trigram_slots(text)
                sizes.append(len(slots))
                sums.append(tables[slots].sum(axis=0, dtype=np.float64).tolist())
                foreign.append(False if text is None or text.isascii() and scripts[0] else 2 * int(scripts[letter_blocks(text)].sum()) < len(letter_blocks(text)))
            columns = [batch.column(c) for c in rest]
            columns += [pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.float64())), pa.array(foreign, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "trigrams", "likely", "foreign"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(weigh, f"{kinds}, trigrams long, likely array<double>, foreign boolean")


def _tally(cells: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
    """(by, name array, rows): how many rows of each value say which language by their text, and how many there are."""
    says = [F.sum(F.when(F.col("says") == k, F.col("rows")).otherwise(0)) for k in range(n)]
    return cells.groupBy(*by).agg(F.array(*says).cast("array<double>").alias(name), F.sum("rows").alias("rows"))


def _said_given_language(tally: DataFrame, by: str, total: list[int]) -> DataFrame:
    """(by, told array): log P(value | language) for each language, smoothed by one more row that has any value."""
    kinds = max(tally.count(), 1)
    sizes = F.array(*[F.lit(float(t) + SAID_WEIGHT * kinds) for t in total]).cast("array<double>")
    return tally.select(by, F.zip_with("said", sizes, lambda c, size: F.log((c + SAID_WEIGHT) / size)).alias(f"{by}_told"))


def _argmax(values: Column, n: int) -> Column:
    best = F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return -best["i"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def identify(
    rows: DataFrame, languages: Sequence[str] | None = None, markup: bool = False, known: Profiles | None = None
) -> DataFrame:
    """rows (key..., text, declared, suffix, host, domain) -> (key..., language, probability, text_language), one row per row.

    key is every column besides those named. The texts are pages with markup where markup is set. known are
    profiles(...), made of these rows where not given, the languages being those declared where they are not given.
    Null or empty evidence is a value like any other, so it tells what its rows tell; a text without letters has no
    likelihood of its own and is undetermined; one in scripts of no profile is in another language, without probability.
    One host, suffix or declaration may hold any share of the rows.
    """
    if known is None:
        known = profiles(rows, languages, markup)
    languages, n = known.languages, len(known.languages)
    keys = [c for c in rows.columns if c not in ("text", "declared", "suffix", "host", "domain")]
    read = rows.select(*keys, "text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("declared", "suffix", "host", "domain")])
    read = settle(_likelihoods(read, known, markup))
    rows = read.withColumn("says", F.when((F.col("trigrams") > 0) & ~F.col("foreign"), _argmax(F.col("likely"), n)))
    places = ["host", "domain"]
    cells = settle(rows.groupBy(*places, "declared", "suffix", "says").agg(F.count(F.lit(1)).alias("rows")))
    counted = {r["says"]: r["n"] for r in cells.groupBy("says").agg(F.sum("rows").alias("n")).collect()}
    total = [counted.get(k, 0) for k in range(n)]
    overall = F.array(*[F.lit((t + 1) / (sum(total) + n)) for t in total]).cast("array<double>")

    hosts = settle(_tally(cells, places, "host_counts", n))
    by_host = hosts.drop("rows").join(_tally(cells, ["domain"], "domain_counts", n).drop("rows"), "domain")

    def without_own(counts: str) -> Column:
        return F.transform(counts, lambda c, k: c - F.coalesce((k == F.col("says")).cast("int"), F.lit(0)))

    def smoothed(rows: DataFrame, name: str, counts: str, prior: Column) -> DataFrame:
        held = rows.withColumn("_held", without_own(counts)).withColumn("_size", _sum(F.col("_held")))
        chance = F.zip_with("_held", prior, lambda h, p: (h + HOST_WEIGHT * p) / (F.col("_size") + HOST_WEIGHT))
        return held.withColumn(name, chance).drop("_held", "_size")

    found = looked_up(rows, by_host, places, hosts.select(*places, "rows"))
    for by in ("declared", "suffix"):
        tally = settle(_tally(cells, [by], "said", n))
        found = looked_up(found, _said_given_language(tally, by, total), [by], tally.select(by, "rows"))
    found = smoothed(smoothed(found, "domain_prior", "domain_counts", overall), "prior", "host_counts", F.col("domain_prior"))
    weight = F.least(F.lit(1.0), F.lit(float(EFFECTIVE)) / F.greatest(F.col("trigrams"), F.lit(1)))
    beside = F.zip_with("declared_told", "suffix_told", lambda d, s: d + s)
    found = found.withColumn("beside", beside).withColumn("weight", weight)
    told = F.zip_with(F.zip_with("likely", "beside", lambda v, b: F.col("weight") * v + b), "prior", lambda t, p: t + F.log(p))
    noise = F.col("weight") * F.col("trigrams") * float(-np.log(SLOTS)) + _sum(F.col("beside")) / max(n, 1) + float(np.log(NOISE_SHARE))
    scored = found.withColumn("told", F.concat(told, F.array(noise)))
    scored = scored.withColumn("best", _argmax(F.col("told"), n + 1)).withColumn("top", F.array_max("told"))
    chance = 1 / F.aggregate("told", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    names = F.array(*map(F.lit, [*languages, UNDETERMINED]))
    unprofiled = (F.col("declared") != "") & ~F.col("declared").isin(list(languages))
    language = (
        F.when(F.col("trigrams") == 0, UNDETERMINED)
        .when(F.col("foreign") | ((F.col("best") == n) & unprofiled), OTHER)
        .otherwise(F.get(names, F.col("best")))
    )
    return scored.select(
        *keys,
        language.alias("language"),
        F.round(F.when((F.col("trigrams") > 0) & ~F.col("foreign"), chance), 4).alias("probability"),
        F.get(names, F.col("says")).alias("text_language"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> rows for identify: what the markup declares and the address says.

    The address suffix is the last label of the host, with the path's first part where that has two letters; the domain
    is the host's last two labels.
    """
    host, path = host_and_path(F.col("url"))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return pages.select(
        F.col("page_id").alias("key"),
        F.col("html").alias("text"),
        declared.alias("declared"),
        F.concat(F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract(path, r"^(/[a-zA-Z]{2})(?:/|$)", 1)).alias("suffix"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1).alias("domain"),
    )


ROW = ["row", "row2"]


def _row_key(docs: DataFrame) -> list[Column]:
    """128 bits of a document's id and text, so that rows do not meet by chance."""
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(2), "text", "doc_id").alias("row2")]


def document_evidence(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) -> rows for identify by (row, row2); the source stands for host and domain."""
    return docs.select(
        *_row_key(docs), "text", F.col("lang").alias("declared"), F.lit("").alias("suffix"), F.col("source").alias("host"), F.col("source").alias("domain")
    )


def in_a_language(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs whose language is determined, languages without a profile being kept."""
    found = identify(document_evidence(docs), languages)
    rejected = settle(found.filter(F.col("language") == UNDETERMINED).select(*ROW).distinct())
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), *_row_key(docs))
    return without(rows, rejected, ROW).select("doc.*")
