"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words and runs of signs, pairs of them, and runs of three word shapes, which speak for words
too rare to be learned; a word that repeats the one before is the feature "again". Each is hashed to one of 2**17 buckets,
where the square roots of the counts are scaled to length 1, so that the score is a sparse dot product at any length.

Training follows the regularised leader (proximal, per coordinate): a bucket's weight is nought until its summed gradients
exceed the L1 bound, so that rare words stay out. The sample's features are written once, dealt to a few shards; in each
pass every shard is read by one task, which goes on from the common state; that then becomes the mean of the tasks' states.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemalign.llm.lookups import looked_up
from schemalign.operators.settle import settle

# Labelled rows the model is fitted on, at most about so many: a sample by hash of the row's number.
TRAIN_ROWS = 10_000
SHARDS, PASSES = 8, 6
BITS = 17
RATE, SMOOTH, L1, L2 = 1.0, 1.0, 0.05, 0.01

_CHARS_AT_ONCE = 1 << 20
_MOST_KNOWN = 400_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SPACE = re.compile(r"\s")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHAPE = np.uint64(15)
_AGAIN = 15


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: a fifth by CRC-32 of doc_id. Documents without one are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _shape(token: str) -> int:
    """Of 0 to 14: signs by how many, numbers, and words by their capitals and length."""
    if not (token[0].isalnum() or token[0] == "_"):
        return min(len(token), 4) - 1
    if token.isdigit():
        return 4
    if not token.isalpha():
        return 5
    long = (len(token) > 4) + (len(token) > 14)
    return 6 + 3 * (0 if token.islower() else 1 if token.isupper() and len(token) > 1 else 2) + long


class _Hashes(dict):
    """Tokens' hashes, the shape in the lowest four bits; made when first asked for."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _MOST_KNOWN:
            self.clear()
        found = self[token] = (xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) & ~15) | _shape(token)
        return found


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _CHARS_AT_ONCE:
        space = _SPACE.search(text, at + _CHARS_AT_ONCE)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def weighed(buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of the counts at length 1, and a constant in the last bucket."""
    values = np.sqrt(counts / counts.sum()) if len(counts) else counts
    return np.append(buckets, 1 << BITS), np.append(values, 1.0)


class Features:
    """Texts -> buckets and what they hold."""

    def __init__(self):
        self.known = _Hashes()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return weighed(*self.counts(text))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, how many features of the text fall in each)."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        before = np.zeros(0, np.uint64)
        for piece in _slices(text or ""):
            tokens = _TOKEN.findall(piece)
            if not tokens:
                continue
            own = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
            all_ = np.concatenate([before, own])
            again = np.zeros(len(all_), bool)
            again[1:] = all_[1:] == all_[:-1]
            told = np.where(again, np.uint64(_AGAIN), all_)
            new, shapes = len(before), told & _SHAPE
            words = told[new:] * _MIX
            pairs = (told[max(new, 1) - 1 : -1] * np.uint64(3) ^ told[max(new, 1) :]) * _MIX
            runs = (shapes[max(new, 2) - 2 : -2] << np.uint64(8) | shapes[max(new, 2) - 1 : -1] << np.uint64(4) | shapes[max(new, 2) :]) if len(told) > 2 else shapes[:0]
            hashed = np.concatenate([words, pairs, (runs + np.uint64(1 << 20)) * _MIX]) >> np.uint64(64 - BITS)
            parts.append(np.unique(hashed, return_counts=True))
            before = all_[-3:]  # one more than a run has before it: whether its first is "again" must be known
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        buckets, counts = parts[0]
        if len(parts) > 1:
            buckets, where = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
        return buckets.astype(np.int64), counts


@dataclass
class Leader:
    """What follow-the-regularised-leader keeps for each bucket: summed gradients, less what was stepped, and their squares."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls) -> Leader:
        return cls(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))

    def packed(self) -> bytes:
        """In single precision, as it is sent."""
        return np.concatenate([self.z, self.n]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, state: bytes) -> Leader:
        return cls(*np.split(np.frombuffer(state, np.float32).astype(float), 2))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((SMOOTH + np.sqrt(self.n[at])) / RATE + L2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (probability(float(values @ w)) - label) * values
        squares = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(squares) - np.sqrt(self.n[at])) / RATE * w
        self.n[at] = squares


def probability(margin: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, quality, number) of labelled rows that are not held out, about train_rows of them at most.

    Several labels of a doc_id count as their mean. Documents that repeat a doc_id are rows of their own.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = settle(known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality")))
    n = looked_up(docs.select("doc_id"), known, ["doc_id"]).count()
    share = F.lit(int(2**32 * min(1.0, train_rows / max(n, 1))))
    numbered = docs.select("doc_id", "text").withColumn("number", F.xxhash64(F.monotonically_increasing_id()))
    sample = numbered.filter(F.col("number").bitwiseAND(F.lit(2**32 - 1)) < share)
    return sample.join(known, "doc_id").select("text", "quality", "number")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of buckets from documents (doc_id, text, ...) and labels (doc_id, quality, ...).

    Only labels outside the held-out fifth are looked at. Without any, all weights are nought.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.counts(text) for text in batch.column("text").to_pylist()]
            lists = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("number"), *lists], ["quality", "number", "buckets", "counts"])

    rows = training_rows(docs, labels, train_rows).mapInArrow(counted, "quality double, number long, buckets array<int>, counts array<int>")
    rows = settle(rows.repartition(SHARDS, "number").sortWithinPartitions("number")).coalesce(SHARDS)
    leader = Leader.new()
    for _ in range(PASSES):
        state = leader.packed()

        def run(batches: Iterator[pa.RecordBatch], state: bytes = state) -> Iterator[pa.RecordBatch]:
            own, seen = Leader.unpacked(state), False
            for batch in batches:
                columns = [batch.column(c) for c in ("quality", "buckets", "counts")]
                for quality, buckets, counts in zip(*columns, strict=True):
                    own.learn(*weighed(buckets.values.to_numpy(), counts.values.to_numpy()), quality.as_py())
                    seen = True
            if seen:
                yield pa.RecordBatch.from_pydict({"state": [own.packed()]})

        # One state for each shard: 8 of 1 MB.
        states = [Leader.unpacked(s["state"]) for s in rows.mapInArrow(run, "state binary").collect()]
        if not states:
            break
        leader = Leader(*[np.mean([getattr(s, c) for s in states], axis=0) for c in ("z", "n")])
    return leader.weights()


def score(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score double, predicted int: 1 from `least` on), one row per row.

    The score is the probability of label 1. Null and empty texts have that of the constant. Whole texts are read, a
    slice at a time; 1 MB of weights goes to every task. Only doc_id and text are looked at.
    """
    schema_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                at, values = features.of(text)
                found.append(probability(float(values @ weights[at])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {schema_type}, score double")
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))
