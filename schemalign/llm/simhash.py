"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits by pigeonring filtering.

Let the 64 bits be a ring of m = limit + 1 segments. If two fingerprints differ in at most `limit` bits, then from some
segment on every chain of l consecutive segments differs in at most l * limit / m bits. The first segment of that chain
is therefore equal and the first two differ in at most one bit, so one half of the second segment is equal, too. First
segment and half of the next form the key under which fingerprints meet; there, chains of growing length are held against
their budgets, and only pairs whose chains all stay within them get the full Hamming check. Nothing is lost that way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemalign.llm.blocks import BLOCK_ROWS, in_cells, lowest_reachable, read_cells
from schemalign.llm.components import components
from schemalign.llm.lookups import among, looked_up, named_by, without
from schemalign.operators.settle import settle

SEED = 42

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_HASHES_AT_ONCE = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])


def text_fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _HASHES_AT_ONCE):
        here = slice(at, at + _HASHES_AT_ONCE)
        some = [digest(joined[a:b], SEED) for a, b in zip(first[here], last[here], strict=True)]
        counts += _bit_counts(np.array(some, np.uint64))
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > n))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, bits long: the 64 bits as a signed number), one row per row.

    A-Z is lower-cased, words are runs of anything but ASCII white space, shingles have `shingle` words, repeats count;
    a shorter text is one shingle, a text without words (null and empty ones) has fingerprint zero.
    """

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bits = np.array([text_fingerprint(t, shingle) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "bits": bits})

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("bits", T.LongType())])
    return docs.select("doc_id", "text").mapInPandas(hashed, schema)


def _ring(limit: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of limit + 1 segments that cover the 64 bits."""
    cuts = np.linspace(0, 64, limit + 2).round().astype(int).tolist()
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _halves(segment: tuple[int, int]) -> list[tuple[int, int]]:
    lo, width = segment
    return [(lo, width // 2), (lo + width // 2, width - width // 2)]


def _cut(lo: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col("bits"), lo).bitwiseAND(F.lit((1 << width) - 1))


def _meeting_keys(limit: int) -> list[Column]:
    """One (start segment, half, value) for every start of a chain and each half of the segment after it."""
    ring = _ring(limit)
    if limit == 0:
        return [F.struct(F.lit(0).alias("start"), F.lit(0).alias("half"), F.col("bits").alias("value"))]
    keys = []
    for start, (lo, width) in enumerate(ring):
        for half, (at, wide) in enumerate(_halves(ring[(start + 1) % len(ring)])):
            value = F.shiftleft(_cut(lo, width), wide).bitwiseOR(_cut(at, wide))
            keys.append(F.struct(F.lit(start).alias("start"), F.lit(half).alias("half"), value.alias("value")))
    return keys


def within_budgets(unlike: np.ndarray, start: np.ndarray, limit: int) -> np.ndarray:
    """Of XORed fingerprints: those whose chains from segment start[i] on all keep to their share of the limit."""
    ring = _ring(limit)
    per_segment = np.stack(
        [np.bitwise_count((unlike >> np.uint64(lo)) & np.uint64((1 << width) - 1)) for lo, width in ring]
    ).astype(np.int16)
    fits, spent, at = np.ones(len(unlike), bool), np.zeros(len(unlike), np.int16), np.arange(len(unlike))
    for length in range(1, len(ring) + 1):
        spent = spent + per_segment[(start + length - 1) % len(ring), at]
        fits &= spent * len(ring) <= length * limit
    return fits


def _forest(limit: int):
    """Of whole cells of (cell, side, whole, start, bits): links between fingerprints that span what is linked."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        cell, side, whole = (frame[c].to_numpy() for c in ("cell", "side", "whole"))
        bits, start = frame["bits"].to_numpy().view(np.uint64), frame["start"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        first, lag = np.arange(len(cell)), 0
        while len(first):
            lag += 1
            first = first[first + lag < len(cell)]
            first = first[cell[first] == cell[first + lag]]
            met = first[whole[first] | (side[first] != side[first + lag])]
            unlike = bits[met] ^ bits[met + lag]
            fits = within_budgets(unlike, start[met], limit)
            met = met[fits][np.bitwise_count(unlike[fits]) <= limit]
            found.append((met, met + lag))
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in zip(*found, strict=True))
        low = lowest_reachable(len(cell), a, b)
        own = np.flatnonzero(low != np.arange(len(cell)))
        signed = bits.view(np.int64)
        return pd.DataFrame({"a": signed[own], "b": signed[low[own]]})

    return links


def links_of(distinct: DataFrame, limit: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """distinct (bits) -> (a, b): links that connect exactly what the relation 'at most limit bits differ' connects."""
    keyed = distinct.select("bits", F.explode(F.array(*_meeting_keys(limit))).alias("k")).select("bits", "k.*")
    cells = in_cells(keyed, ["start", "half", "value"], "bits", block_rows)
    return read_cells(cells.select("cell", "side", "whole", "start", "bits"), _forest(limit), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, limit: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint 16 hex digits, component_id), one row per row.

    Documents are linked if at most `limit` bits of their fingerprints differ; component_id is the smallest doc_id that
    can be reached, the own one included. Equal fingerprints are one node, so copies are never compared. Rows that
    repeat a doc_id are kept; a null doc_id never names a component, unless a whole component has none. An empty table
    gives an empty result; other columns are not looked at.
    """
    prints = settle(fingerprints(docs, shingle))
    nodes = settle(prints.groupBy("bits").agg(F.min("doc_id").alias("lowest_id"), F.count(F.lit(1)).alias("rows")))
    linked = components(links_of(nodes.select("bits"), limit, block_rows))
    members = nodes.join(linked.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "component", F.coalesce("component", "bits")
    )
    named = settle(members.groupBy("component").agg(F.min("lowest_id").alias("component_id")))
    lookup = named_by(members.select("bits", "component"), named, ["component"]).select("bits", "component_id")
    found = looked_up(prints, lookup, ["bits"], nodes.select("bits", "rows"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> the rows of docs whose doc_id names their component.

    Of rows that repeat such a doc_id one stays. Rows without doc_id stay, as nothing can name them.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), shingle, limit).filter("doc_id IS NOT NULL")
    stays = F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")
    by_id = settle(groups.groupBy("doc_id").agg(stays, F.count(F.lit(1)).alias("rows")))
    gone = settle(by_id.filter("NOT stays").select("doc_id"))
    kept = without(docs, gone, "doc_id")
    repeated = settle(by_id.filter("stays AND rows > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = among(docs, repeated, "doc_id").dropDuplicates(["doc_id"])
        kept = without(kept, repeated, "doc_id").unionByName(once)
    return kept.select(*docs.columns)
