"""Packing by optimal length buckets.

The lengths of all sequences make one histogram; dynamic programming over it chooses the bucket lengths that add the least
padding. Inside a bucket, sequences are counted through without gaps and cut into batches that fill a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemalign.operators.settle import settle

MAX_TOKENS = 2048
BUCKETS = 16
BATCH_TOKENS = 65_536
SHARD_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def choose_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending lengths with their counts -> at most `buckets` of them that pad the least in all, the longest included.

    least[j] is the padding of the first j lengths; adding one more bucket that ends at j starts it at the best i < j:
    the sequences i..j-1 are padded to lengths[j-1]. Of equally good choices the one with the lowest starts is taken.
    """
    m = len(lengths)
    if not m:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    never = np.int64(2**62)
    least = np.full(m + 1, never)
    least[0] = 0
    starts = []
    ends = np.arange(1, m + 1)
    for _ in range(min(buckets, m)):
        after, start = np.full(m + 1, never), np.zeros(m + 1, np.int64)
        for some in np.array_split(ends, max(1, m * m // 4_000_000)):
            padding = lengths[some - 1, None] * (upto[some, None] - upto[None, :-1]) - (tokens[some, None] - tokens[None, :-1])
            total = np.where((np.arange(m)[None, :] < some[:, None]) & (least[None, :-1] < never), least[None, :-1] + padding, never)
            start[some] = total.argmin(axis=1)
            after[some] = total[np.arange(len(some)), start[some]]
        starts.append(start)
        least = after
        if len(starts) > 1 and least[m] == 0:
            break
    chosen, j = [], m
    for start in reversed(starts):
        chosen.append(int(lengths[j - 1]))
        j = int(start[j])
        if j == 0:
            break
    return chosen[::-1]


def sequences(docs: DataFrame, n_tokens: Column, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """docs (doc_id, ...) -> (doc_id, piece, first_token, n_tokens): longer documents go on in further pieces.

    A document without tokens is one piece of none.
    """
    sized = docs.select("doc_id", n_tokens.cast("long").alias("total"))
    last = F.greatest(F.ceil(F.col("total") / max_tokens) - 1, F.lit(0)).cast("long")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("piece") * max_tokens
    return pieces.select(
        "doc_id", "piece", first.alias("first_token"), F.least(F.lit(max_tokens), F.col("total") - first).alias("n_tokens")
    )


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def pack(
    docs: DataFrame,
    n_tokens: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, piece, first_token, n_tokens, bucket, padded_to, batch, slot).

    Tokens are words unless n_tokens tells their number. batch counts a bucket's batches from 0, each with as many slots
    as its padded length fits into batch_tokens (one at least); all but a bucket's last batch are full. Pieces without
    tokens have no bucket, batch and slot. The order within a bucket is that of a hash of doc_id and piece.

    The histogram has at most max_tokens rows, whatever the data. A bucket's rows are ranked in shards of about
    shard_rows rows, and the shards' sizes added up, so no task sees a whole bucket.
    """
    cut = settle(sequences(docs, word_count(F.col("text")) if n_tokens is None else n_tokens, max_tokens))
    histogram = cut.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).orderBy("n_tokens").collect()
    lengths = np.array([r["n_tokens"] for r in histogram], np.int64)
    counts = np.array([r["rows"] for r in histogram], np.int64)
    ends = choose_buckets(lengths, counts, buckets) or [max_tokens]
    of_length = np.searchsorted(ends, lengths)
    rows = np.bincount(of_length, counts, len(ends)).astype(int).tolist()
    shards = [max(1, -(-n // shard_rows)) for n in rows]
    bucket = sum((F.when(F.col("n_tokens") > end, 1).otherwise(0) for end in ends[:-1]), F.lit(0)).cast("int")
    drawn = F.xxhash64("doc_id", "piece")
    placed = (
        cut.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket))
        .withColumn("padded_to", _pick(ends, F.col("bucket")))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "piece"), _pick(shards, F.col("bucket"))))
    )
    full = placed.filter("bucket IS NOT NULL")
    sizes = full.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("rows"))
    running = F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("rows")
    in_shard = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(drawn, "doc_id", "piece", "n_tokens"))
    ranked = full.withColumn("nth", in_shard).join(sizes.select("bucket", "shard", running.alias("before")), ["bucket", "shard"])
    place = F.col("before") + F.col("nth") - 1
    slots = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("padded_to"))).cast("long")
    names = ["doc_id", "piece", "first_token", "n_tokens", "bucket", "padded_to"]
    done = ranked.select(*names, F.floor(place / slots).cast("long").alias("batch"), F.pmod(place, slots).alias("slot"))
    no_place = F.lit(None).cast("long")
    empty = placed.filter("bucket IS NULL").select(*names, no_place.alias("batch"), no_place.alias("slot"))
    return done.unionByName(empty)
