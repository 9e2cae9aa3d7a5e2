"""Benchmark decontamination by spaced seeds.

A seed is a run of words of which a fixed mask looks at some; a substituted word under a zero of the mask changes
nothing. The masks for a length hit every pattern of substitutions that the identity allows. Seeds of the benchmark and
of the documents meet by their hashes. Every hit names a diagonal, document position minus item position, along which
words are compared one by one: an item is found where a window of `window` words (the whole item if it is shorter) has at
least `identity` equal ones, or where RUN words in a row are equal, which also tells passages that an end of the document
cuts. Items of fewer than five words are found where all their words stand in a row. In scripts that set no blanks every
character is a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.llm.lookups import looked_up, without
from schemalign.operators.settle import settle

# (width, substitutions, masks): in any window that wide or wider, with so many words substituted at most, one mask fits
# somewhere. The tests try all patterns. No mask is longer than RUN.
LONG = ("1111011", "11001000111", "1101010000101")
MASK_SETS = (
    (20, 4, LONG),
    (15, 3, LONG),
    (10, 2, ("111011", "11010011", "11111")),
    (5, 1, ("1111", "11101", "11011", "10111")),
)
WINDOW = 20
IDENTITY = 0.8
RUN = 13
MOST_FILTER_BITS = 1 << 27

# Thai to Lao, Tibetan to Myanmar, Khmer, kana, Han; these scripts set no blanks between words.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_PLACES = (0, 21, 42)


class _Hashes(dict):
    """Word -> 64-bit hash, kept for words met before."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 250_000:
            self[word] = value
        return value


def word_hashes(text: str | None, known: _Hashes) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash for every position at which the mask fits; words the mask ignores take no part."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, xxhash.xxh64_intdigest(mask.encode()), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = (total ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return total


def _masks_for(n_words: int, window: int = WINDOW, identity: float = IDENTITY) -> tuple[str, ...]:
    """Masks that hit every window with enough equal words, and every run of RUN words, of an item of n_words.

    Beyond the sets, one mask as long as the longest run that substitutions must leave somewhere.
    """
    width = min(window, n_words)
    lost = width - next(n for n in range(width + 1) if n >= identity * width)
    for least, most, masks in MASK_SETS:
        if width >= least and lost <= most:
            return masks
    return ("1" * max(1, min(RUN, -(-(width - lost) // (lost + 1)))),)


def _items(benchmark: DataFrame) -> DataFrame:
    """benchmark (item_id, text) -> (item long, item_id, words array<long>): every id and text once, numbered."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for frame in frames:
            words = [word_hashes(t, known).view(np.int64) for t in frame["text"]]
            yield pd.DataFrame({"item_id": frame["item_id"], "words": words})

    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    told = named.mapInPandas(read, "item_id long, words array<long>").filter(F.size("words") > 0)
    return told.select(F.monotonically_increasing_id().alias("item"), "item_id", "words")


def _seeds(items: DataFrame, window: int = WINDOW, identity: float = IDENTITY) -> DataFrame:
    """items (item, words) -> (item, hash, at): a row for each seed of each item."""

    def seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, words in zip(frame["item"], frame["words"], strict=True):
                for mask in _masks_for(len(words), window, identity):
                    found = seed_hashes(np.asarray(words).view(np.uint64), mask).view(np.int64)
                    yield pd.DataFrame({"item": item, "hash": found, "at": np.arange(len(found), dtype=np.int32)})

    return items.select("item", "words").mapInPandas(seeds, "item long, hash long, at int")


def _filter_bits(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """A bit field with three bits set for every seed: (number of bits, 64-bit words).

    It has 512 to 1024 bits a seed up to MOST_FILTER_BITS (16 MB), so about one position in some millions passes by
    chance; beyond that it lets more through, which costs time and loses nothing, as every seed it passes is joined
    exactly.
    """
    n = seeds.count()
    bits = min(MOST_FILTER_BITS, 1 << max(16, (512 * n).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(bits - 1)) for s in _PLACES]))
    places = seeds.select(place.alias("p"))
    rows = (
        places.groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("set"))
        .toPandas()
    )
    field = np.zeros(bits // 64, np.uint64)
    field[rows["word"].to_numpy(dtype=np.int64)] = rows["set"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits, field


def _may_be_in(hashes: np.ndarray, bits: int, field: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for shift in _PLACES:
        p = (hashes >> np.uint64(shift)) & np.uint64(bits - 1)
        hit &= (field[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


# A document row is told by 128 bits of its id and text, so that rows do not meet by chance.
ROW = ["row", "row2"]


def _row_key(docs: DataFrame) -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(2), "text", "doc_id").alias("row2")]


def _hits(docs: DataFrame, items: DataFrame, seeds: DataFrame, window: int = WINDOW, identity: float = IDENTITY) -> DataFrame:
    """(row, row2, words array<long>, hashes, places) of documents with a seed that may be one of the benchmark's."""
    bits, field = _filter_bits(seeds)
    widths = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()]
    masks = sorted({mask for n in widths for mask in _masks_for(n, window, identity)})
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            out: list[tuple] = []
            for row, row2, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = word_hashes(text, known)
                hashes = [seed_hashes(words, m) for m in masks]
                hits = [np.flatnonzero(_may_be_in(h, bits, sent.value)) for h in hashes]
                if any(map(len, hits)):
                    some = np.concatenate([h[at] for h, at in zip(hashes, hits, strict=True)])
                    out.append((row, row2, words.view(np.int64), some.view(np.int64), np.concatenate(hits)))
            columns = list(zip(*out, strict=True)) or [[] for _ in range(5)]
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*ROW, "words", "hashes", "places"])

    keyed = docs.select(*_row_key(docs), "text")
    return keyed.mapInArrow(found, "row long, row2 long, words array<long>, hashes array<long>, places array<long>")


def best_window(doc: np.ndarray, item: np.ndarray, diagonal: int, window: int) -> tuple[int, int, int]:
    """Along a diagonal: (start in the document, width, equal words) of the first window with the most equal words."""
    width = min(window, len(item))
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    if high - low < width:
        return low, width, 0
    equal = np.cumsum(np.concatenate([[0], doc[low:high] == item[low - diagonal : high - diagonal]]))
    sums = equal[width:] - equal[:-width]
    at = int(sums.argmax())
    return low + at, width, int(sums[at])


def exact_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """Along a diagonal: (start in the document, length) of the first longest run of equal words."""
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    ends = np.flatnonzero(np.concatenate([[True], doc[low:high] != item[low - diagonal : high - diagonal], [True]]))
    lengths = np.diff(ends) - 1
    at = int(lengths.argmax())
    return low + int(ends[at]), int(lengths[at])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, identity: float = IDENTITY
) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> (row, row2, item_id, doc_start, item_start, n_words, n_equal).

    One row per document row and item found in it, with the best window (of several, the first in the document) or, where
    no window reaches the identity, the longest run of equal words, RUN at least. row and row2 are hashes of doc_id and
    text, so repeated rows are one. Every text of an item_id is an item of its own, equal ones are one. Words are runs of
    letters, digits and underscores in lower case. Null items, those without id and those without a word are not looked
    for; null and empty texts contain nothing. An empty table on either side gives no rows.
    """
    items = settle(_items(benchmark))
    seeds = settle(_seeds(items, window, identity))
    marked = settle(_hits(docs, items, seeds, window, identity))
    hits = marked.select(*ROW, F.explode(F.arrays_zip("hashes", "places")).alias("h")).select(
        *ROW, F.col("h.hashes").alias("hash"), F.col("h.places").alias("place")
    )
    meant = seeds.groupBy("hash").agg(F.collect_set(F.struct("item", "at")).alias("of"))
    met = looked_up(hits, meant, ["hash"]).select(*ROW, "place", F.explode("of").alias("o"))
    diagonals = met.groupBy(*ROW, F.col("o.item").alias("item")).agg(F.collect_set(F.col("place") - F.col("o.at")).alias("diagonals"))
    diagonals = settle(diagonals)
    beside = looked_up(diagonals, items.withColumnRenamed("words", "item_words"), ["item"])
    pairs = beside.join(marked.select(*ROW, "words").dropDuplicates(ROW), ROW)

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, row2, item_id, words, item, lines in frame.itertuples(index=False):
                tried = [(*best_window(words, item, int(d), window), int(d)) for d in np.sort(lines)]
                start, width, equal, line = max(tried, key=lambda t: (t[2], -t[0]))
                if equal < identity * width:
                    runs = [(*exact_run(words, item, int(d)), int(d)) for d in np.sort(lines)]
                    start, width, line = max(runs, key=lambda t: (t[1], -t[0]))
                    equal = width
                    if width < RUN:
                        continue
                out.append((row, row2, item_id, start, start - line, width, equal))
            yield pd.DataFrame(out, columns=[*ROW, "item_id", "doc_start", "item_start", "n_words", "n_equal"])

    schema = "row long, row2 long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
    return pairs.select(*ROW, "item_id", "words", "item_words", "diagonals").mapInPandas(verified, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, identity: float = IDENTITY) -> DataFrame:
    """The overlaps with the doc_id of their documents; a row for every row of docs that holds an item."""
    found = settle(overlaps(docs, benchmark, window, identity))
    return docs.select("doc_id", *_row_key(docs)).join(found, ROW).drop(*ROW)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, identity: float = IDENTITY) -> DataFrame:
    """The rows of docs in which no item is found."""
    found = settle(overlaps(docs, benchmark, window, identity).select(*ROW).distinct())
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), *_row_key(docs))
    return without(rows, found, ROW).select("doc.*")
