"""Hard negatives by an inverted multi-index.

Vectors are cut in halves and each half has a codebook; a cell is a pair of codewords. A half's inner product with a query
is at most that of its codeword plus the query half's length times the codeword's radius, the largest distance of a half
to its codeword. A heap walks the two codebooks, each sorted by that bound, and gives the cells by falling sum of both.

A search goes on in rounds: every open query asks for its next cells, more in each round; cells are blocks of bounded
size, which meet the queries that visit them by an equi-join; the best rows are kept for each window of scores. A query
is done when all of its windows are certified: the next cell's bound lies below the window, or below the last row kept.
So the answers are those of a full scan. Codebooks are fitted on a sample, every row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemalign.llm.lookups import looked_up
from schemalign.operators.settle import settle
from schemalign.operators.skew import salted_lookup

# The codebooks are fitted on about so many rows at most, by hash, and on so many numbers.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 1 << 22
# Rows a cell is to have, and the most codewords of a half: the table of cells, which all tasks get, has at most 65,536.
CELL_ROWS, MOST_CODEWORDS = 256, 256
BLOCK_ROWS = 512
# Rows each query asks for in the first round, and how many times as many in each following one.
FIRST_ROWS, GROWTH = 8192, 4
# A label that lies in so few cells is looked for in those only.
FEW_CELLS = 64
# Vectors take part whose length is below this, so that inner products fit a long.
LONGEST = 2.0**31
LOWEST = -(1 << 62)
SEED = 12


def scaled(embedding: str, by: int = 256) -> Column:
    """floor(by * x) of every component, in double precision; null for vectors that take no part."""
    known = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    whole = F.transform(F.col(embedding).cast("array<double>"), lambda x: F.floor(x * by).cast("double"))
    size = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(known & (size < LONGEST), F.transform(whole, lambda x: x.cast("int")))


@dataclass
class Book:
    """What all tasks know of the cells: codewords, radii, lengths; rows and blocks of each cell."""

    words: list[np.ndarray]  # one array (codewords, dims of the half) for each half
    radii: list[np.ndarray]
    rows: np.ndarray  # (codewords, codewords)

    @property
    def cut(self) -> int:
        return self.words[0].shape[1]

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) by falling bound; the bound holds for every inner product of the query with the cell's rows."""
        halves = [query[: self.cut], query[self.cut :]]
        sizes = [float(np.sqrt(h @ h)) for h in halves]
        bounds = [w @ h + s * r for w, r, h, s in zip(self.words, self.radii, halves, sizes, strict=True)]
        longest = [float(np.sqrt((w * w).sum(axis=1).max())) + float(r.max()) for w, r in zip(self.words, self.radii, strict=True)]
        slack = 1 + 1e-9 * sum(s * n for s, n in zip(sizes, longest, strict=True))
        first, second = (np.argsort(-b, kind="stable") for b in bounds)
        one, two = bounds[0][first], bounds[1][second]
        heap, seen, codes = [(-(one[0] + two[0]), 0, 0)], {(0, 0)}, len(second)
        while heap:
            bound, a, b = heapq.heappop(heap)
            yield slack - bound, int(first[a]) * codes + int(second[b])
            for place in ((a + 1, b), (a, b + 1)):
                if place[0] < len(first) and place[1] < codes and place not in seen:
                    seen.add(place)
                    heapq.heappush(heap, (-(one[place[0]] + two[place[1]]), *place))


@dataclass
class Index:
    blocks: DataFrame  # (cell, part, vec_ids, rows, labels, vectors), packed
    parts: DataFrame  # (cell, parts)
    places: DataFrame  # (label, cells) of labels that lie in few cells
    book: Book
    dims: int


def _nearest(half: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1) / 2 - half @ words.T).argmin(axis=1)


def _codewords(half: np.ndarray, wanted: int) -> np.ndarray:
    """k-means: some of the distinct halves to start with, then a few rounds of means."""
    distinct = np.unique(half, axis=0)
    draw = np.random.default_rng(SEED)
    words = distinct[draw.choice(len(distinct), min(wanted, len(distinct)), replace=False)].astype(float)
    for _ in range(8):
        own = _nearest(half, words)
        counts = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, half)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def _matrix(values: pa.Array | list, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, short ones filled with zeros."""
    out = np.zeros((len(values), dims))
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def build(rows: DataFrame, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> Index | None:
    """rows (row long, vec_id long, label long, v array<int>), settled -> an index; None without rows."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    if not size["n"]:
        return None
    dims = max(size["dims"], 2)
    asked = min(SAMPLE_ROWS, max(SAMPLE_NUMBERS // dims, 256))
    share = int(2**32 * min(1.0, asked / size["n"]))
    chosen = rows.filter(F.xxhash64("row").bitwiseAND(F.lit(2**32 - 1)) <= share).select("v").toArrow()
    sample = _matrix(chosen.column("v").to_pylist() or rows.limit(1).toArrow().column("v").to_pylist(), dims)
    wanted = min(MOST_CODEWORDS, max(2, int(np.ceil(np.sqrt(size["n"] / cell_rows)))))
    cut = dims // 2
    words = [_codewords(sample[:, :cut], wanted), _codewords(sample[:, cut:], wanted)]
    codes = len(words[1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), dims)
            halves = [x[:, :cut], x[:, cut:]]
            own = [_nearest(h, w) for h, w in zip(halves, words, strict=True)]
            far = [np.sqrt(((h - w[k]) ** 2).sum(axis=1)) for h, w, k in zip(halves, words, own, strict=True)]
            packed = [v.tobytes() for v in x.astype("<i4")]
            new = {"cell": pa.array((own[0] * codes + own[1]).astype(np.int32)), "far_1": pa.array(far[0]), "far_2": pa.array(far[1]), "q": pa.array(packed, pa.binary())}
            kept = {c: batch.column(c) for c in ("row", "vec_id", "label")}
            yield pa.RecordBatch.from_pydict(kept | new)

    fields = "row long, vec_id long, label long, cell int, far_1 double, far_2 double, q binary"
    lying = settle(rows.select("row", "vec_id", "label", "v").mapInArrow(placed, fields))
    table = lying.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far_1").alias("a"), F.max("far_2").alias("b")).toPandas()
    counts, radii = np.zeros((len(words[0]), codes), np.int64), [np.zeros(len(w)) for w in words]
    first, second = np.divmod(table["cell"].to_numpy(), codes)
    counts[first, second] = table["n"]
    np.maximum.at(radii[0], first, table["a"].to_numpy())
    np.maximum.at(radii[1], second, table["b"].to_numpy())
    parts = settle(lying.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")))

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        numbers = {f"{c}s": [block[c].to_numpy("<i8").tobytes()] for c in ("vec_id", "row", "label")}
        return pd.DataFrame({"cell": block["cell"].iloc[:1], "part": block["part"].iloc[:1], **numbers, "vectors": [b"".join(block["q"])]})

    dealt = lying.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    blocks = dealt.select("cell", "part", "vec_id", "row", "label", "q").groupBy("cell", "part")
    blocks = settle(blocks.applyInPandas(packed, "cell int, part int, vec_ids binary, rows binary, labels binary, vectors binary"))
    held = lying.select("label", "cell").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rare = settle(held.filter(F.col("n") <= FEW_CELLS).select("label"))
    lie = looked_up(lying.select("label", "cell").distinct(), rare, ["label"])
    places = settle(lie.groupBy("label").agg(F.collect_list("cell").alias("cells")))
    return Index(blocks, parts, places, Book(words, radii, counts), dims)


def _queries(index: Index, rows: DataFrame) -> DataFrame:
    """rows (row, label, v, ...) of the index -> the same with q, the vector as bytes of the index' width."""
    dims = index.dims

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), dims).astype("<i4")
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("row", "vec_id", "label")} | {"q": pa.array([v.tobytes() for v in x], pa.binary())})

    return rows.select("row", "vec_id", "label", "v").mapInArrow(packed, "row long, vec_id long, label long, q binary")


_STATE = ["row", "label", "q", "lows", "highs", "places", "done"]


def _next_cells(book: Book, asked: int):
    """Of open queries: the cells to visit next, none if all windows are certified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = book.rows.ravel()
        for batch in batches:
            cells, done = [], []
            names = ("q", "floors", "places", "done")
            for q, floors, places, skipped in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                least, met, steps, chosen = min(floors), 0, 0, []
                among = None if places is None else set(places)
                for bound, cell in book.walk(np.frombuffer(q, "<i4").astype(float)):
                    if bound < least or met >= asked:
                        break
                    steps += 1
                    if steps > skipped and counts[cell] and (among is None or cell in among):
                        chosen.append(cell)
                        met += int(counts[cell])
                cells.append(chosen)
                done.append(steps)
            kept = {n: batch.column(n) for n in batch.schema.names if n != "done"}
            yield pa.RecordBatch.from_pydict(kept | {"done": pa.array(done, pa.int64()), "cells": pa.array(cells, pa.list_(pa.int32()))})

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: in doubles where those are exact, else in 64-bit numbers."""
    x, y = a.astype(float), b.astype(float)
    longest = [np.sqrt((m * m).sum(axis=1).max(initial=0)) for m in (x, y)]
    if longest[0] * longest[1] < 2**52:
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best_in_windows(best: int, same: bool, dims: int):
    """Of one block and queries that visit it: for each window the best rows that can still count."""

    def run(key: tuple, visits: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for held in block.itertuples(index=False):
            vec_ids, rows, labels = (np.frombuffer(b, "<i8") for b in (held.vec_ids, held.rows, held.labels))
            scores = products(np.frombuffer(b"".join(visits["q"]), "<i4").reshape(-1, dims), np.frombuffer(held.vectors, "<i4").reshape(-1, dims))
            for visit, score in zip(visits.itertuples(index=False), scores, strict=True):
                fits = ((labels == visit.label) == same) & (rows != visit.row) & (score >= min(visit.floors)) & (score <= max(visit.highs))
                at = np.flatnonzero(fits)
                at = at[np.lexsort((vec_ids[at], -score[at]))]
                falling = -score[at]
                for k, (low, high) in enumerate(zip(visit.lows, visit.highs, strict=True)):
                    start = int(np.searchsorted(falling, -high))
                    for j in at[start : start + best]:
                        if score[j] < low:
                            break
                        out.append((visit.row, k, int(score[j]), int(vec_ids[j])))
        return pd.DataFrame(out, columns=["row", "window", "score", "vec_id"])

    return run


def search(queries: DataFrame, index: Index, best: int, same: bool, first_rows: int = FIRST_ROWS) -> DataFrame:
    """The best rows for each query and window of scores -> (row, window, place, score, vec_id).

    queries (row, label, q, lows, highs, places): a query is a row of the index and never finds itself; it looks for rows
    of its own label if same, else of others. Window k holds the scores from lows[k] to highs[k]. places, where not null,
    are the only cells that can hold a fitting row. Higher scores come first, ties by smaller vec_id.
    """
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    session = queries.sparkSession
    found = session.createDataFrame([], "row long, window int, score long, vec_id long, place int")
    state = queries.select(*_STATE[:-1], F.lit(0).cast("long").alias("done"), F.col("lows").alias("floors"))
    asked = first_rows
    while True:
        schema = f"{', '.join(f'{c} {state.schema[c].dataType.simpleString()}' for c in state.columns if c != 'done')}, done bigint, cells array<int>"
        step = settle(state.select(*[c for c in state.columns if c != "done"], "done").mapInArrow(_next_cells(index.book, asked), schema))
        going = step.filter(F.size("cells") > 0)
        if going.isEmpty():
            return found
        visits = going.select("row", "label", "q", "lows", "highs", "floors", F.explode("cells").alias("cell"))
        copies = F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("copies")
        # One row for each cell, so 65,536 at most.
        sizes = F.broadcast(settle(visits.groupBy("cell").agg(copies).join(F.broadcast(index.parts), "cell")))
        keys = ["cell", "part", "copy"]
        asking = visits.join(sizes, "cell").withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int"))
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "copies")
        lying = index.blocks.join(sizes.select("cell", "copies"), "cell")
        lying = lying.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        met = asking.groupBy(*keys).cogroup(lying.groupBy(*keys))
        new = met.applyInPandas(_best_in_windows(best, same, index.dims), "row long, window int, score long, vec_id long")
        both = found.drop("place").unionByName(new).withColumn("place", F.row_number().over(order))
        found = settle(both.filter(F.col("place") <= best))
        full = found.filter(F.col("place") == best).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full"))
        floors = F.transform("lows", lambda low, k: F.coalesce(F.element_at("full", k), low))
        state = going.select(*_STATE).join(full, "row", "left").select(*_STATE, F.when(F.col("full").isNull(), F.col("lows")).otherwise(floors).alias("floors"))
        asked *= GROWTH


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least: tuple[int, int] = (80, 100),
    first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """vectors (vec_id, label, v array<int>, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which the column `anchor` holds. An anchor's positives are the other rows of its label with
    the highest inner products; a positive's negatives are the highest of rows with other labels whose product is at most
    the positive's and at least least[0] / least[1] of it. Ties go by smaller vec_id; a product is a long.

    Rows without vec_id, label or vector take no part. A shorter vector counts as filled up with zeros. Rows that repeat
    a vec_id are rows of their own. Positives below zero have no negatives. An empty table gives an empty result; other
    columns are not looked at. Rounds are written to the shared folder.
    """
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    known = known.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = settle(known.withColumn("row", F.monotonically_increasing_id()))
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], empty)
    anchors = settle(_queries(index, rows.filter("anchor")))
    placed = salted_lookup(anchors, index.places.withColumnRenamed("cells", "places"), ["label"], "left")
    whole = [F.array(F.lit(LOWEST)).alias("lows"), F.array(F.lit(-LOWEST)).alias("highs")]
    near = search(placed.select("row", "label", "q", *whole, "places"), index, positives, True, first_rows)
    pairs = settle(near.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"))
    asked = pairs.filter("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("highs"))
    windows = asked.select("row", "highs", F.transform("highs", lambda h: F.ceil(h.cast("decimal(20,0)") * least[0] / least[1]).cast("long")).alias("lows"))
    seeking = anchors.join(windows, "row").select("row", "label", "q", "lows", "highs", F.lit(None).cast("array<int>").alias("places"))
    far = search(seeking, index, negatives, False, first_rows)
    named = windows.select("row", F.posexplode("highs").alias("window", "positive_score"))
    far = far.join(named, ["row", "window"]).select("row", "positive_score", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = pairs.join(far, ["row", "positive_score"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
