"""Token ids in files of directly addressable codes.

A segment holds the ids of some whole documents. Every id is cut into chunks of eight bits, lowest first: level 0 has the
first chunk of each id, level k the next chunk of those ids that need more. A bitmap per level tells which ids go on, and
a directory with the number of set bits before every block of 512 gives an id's place in the next level, so any id is
read by one look per level without decoding its neighbours.

Bytes of a segment: b"DAC1", number of levels (u4), then per level number of entries (u8), the chunks, the bitmap padded
to whole blocks, the directory (u8 per block); numbers are little-endian.

Segments are rows of Parquet files: (part, segment, n_docs, n_tokens, doc_ids, lengths, payload). Spark's writer commits
each task once, whatever executors are lost, and works with every store Spark writes to.
"""

from __future__ import annotations

import functools
import json
import os
import string
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"DAC1"
BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 20

# Encoded words a task's process keeps, for speed only; others are encoded anew.
KEPT_WORDS = 800_000
COUNT_KEPT_WORDS = 500_000
TASK_KEPT_WORDS = 100_000
DOCS_AT_ONCE = 2048

# A blank at an end of the text or beside other white space.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_IRREGULAR = f"(?:{_SPACE} |^ | {_SPACE}| $)"
_MARKS = frozenset(".,;:!?")

SEGMENTS = "part int, segment int, n_docs int, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        blocks = -(-len(rest) // BLOCK_BITS)
        bitmap = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
        bits = np.packbits(more, bitorder="little")
        bitmap[: len(bits)] = bits
        ones = np.bitwise_count(bitmap).reshape(blocks, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if blocks else np.zeros(0, "<u8")
        levels.append(b"".join([np.uint64(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]))
        if not more.any():
            return b"".join([MAGIC, np.uint32(len(levels)).tobytes(), *levels])
        rest = rest[more] >> 8


class Segment:
    """A packed segment, read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(int(np.frombuffer(payload, "<u4", 1, 4)[0])):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            blocks = -(-n // BLOCK_BITS)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bitmap = np.frombuffer(payload, np.uint8, blocks * BLOCK_BITS // 8, at + 8 + n)
            at += 8 + n + blocks * BLOCK_BITS // 8
            self.levels.append((chunks, bitmap, np.frombuffer(payload, "<u8", blocks, at)))
            at += 8 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """One id, by its number in the segment."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            before = bitmap[block * BLOCK_BITS // 8 : i >> 3]
            part = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + part.bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            own[np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))] |= values << np.uint32(8)
            values = own
        return values


class _Kept(dict):
    """Text -> its ids as bytes, made where missing; what was not asked for since the last but one clearing is dropped."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        self[text] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a tokenizer file.

    Byte-level vocabularies with their usual pattern cut before every blank between words whatever stands around it, so
    there each distinct word is given to the tokenizer's cutter and model once; with any other file whole texts are
    encoded, and so are texts that hold the content of an added token, as the library finds those before it cuts.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cutter = parts.get("pre_tokenizer") or {}
        self.by_word = (
            parts.get("normalizer") is None
            and cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space")
            and parts["model"].get("type") == "BPE"
            and all(t["special"] for t in parts.get("added_tokens", ()))
        )
        self.added = [t["content"] for t in parts.get("added_tokens", ()) if t["content"]]
        self.cut, self.find = self.tokenizer.pre_tokenizer, self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.pieces = _Kept(self._piece, kept_words)
        self.later = _Kept(self._after_blank, kept_words)

    def forget(self) -> None:
        """Drop the words kept."""
        for kept in (self.pieces, self.later):
            kept.clear()
            kept.older = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        return array("I", [token.id for token in self.find(piece)]).tobytes()

    def _after_blank(self, word: str) -> bytes:
        """Ids of a word with the blank before it; letters alone are one piece in any Unicode version."""
        if word.isalpha():
            if word.isascii():
                return self._piece(self.letters[32] + word)
            if max(word) < "\u0250":
                return self._piece((" " + word).encode().decode("latin-1").translate(self.letters))
        elif word[-1:] in _MARKS and word[:-1].isalpha() and max(word) < "\u0250":
            return self.later[word[:-1]] + self.pieces[word[-1]]
        return self._chunk(" " + word)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(self.pieces[piece] for piece, _ in self.cut.pre_tokenize_str(chunk))

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded whole."""
        if not self.by_word:
            return np.ones(len(texts), bool)
        whole = pc.match_substring_regex(texts, _IRREGULAR)
        for content in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        return whole.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text). Nulls are empty texts."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = self._whole(texts)
        if whole.any():
            plain = iter(self._plain(texts.filter(pa.array(whole)).to_pylist()))
            ids, sizes = self._by_word(texts.filter(pa.array(~whole)))
            regular = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            parts = [np.frombuffer(next(plain), "<u4") if w else next(regular) for w in whole]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        return self._by_word(texts)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts whose blanks all stand alone between two words: each distinct word is looked up once."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        starts, place, table = self._table(texts)
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        known = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(table), "<u4")))
        ids = known.take(pa.array(place)).flatten().to_numpy()
        return ids, np.add.reduceat(sizes[place], starts)

    def _table(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(first word of each text, each word's place in the table, the table of ids)."""
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()[:-1]
        words = split.flatten()
        coded = words.dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        first = [self._chunk(w) for w in words.take(pa.array(starts)).to_pylist()]
        table = [*map(self.later.__getitem__, coded.dictionary.to_pylist()), *first]
        place[starts] = len(coded.dictionary) + np.arange(len(starts))
        return starts, place, table

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, as encode gives it, without putting the ids together."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = self._whole(texts)
        total = np.zeros(len(texts), np.int64)
        total[whole] = [len(ids) // 4 for ids in self._plain(texts.filter(pa.array(whole)).to_pylist())]
        if not whole.all():
            starts, place, table = self._table(texts.filter(pa.array(~whole)))
            each = np.fromiter(map(len, table), np.int64, len(table)) // 4
            total[~whole] = np.add.reduceat(each[place], starts)
        return total


@functools.lru_cache(maxsize=2)
def encoder(path: str, kept_words: int = KEPT_WORDS) -> Encoder:
    return Encoder(path, kept_words)


def count_tokens(docs: DataFrame, tokenizer_path: str, keep_words: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_tokens): the number of ids of each whole text, 0 for null.

    Without keep_words a process keeps fewer words, and drops them and the tokenizer when a task ends, so that they take no
    memory from what comes after.
    """
    kept_words = COUNT_KEPT_WORDS if keep_words else TASK_KEPT_WORDS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                some = batch.slice(at, DOCS_AT_ONCE)
                n_tokens = pa.array(encoder(tokenizer_path, kept_words).sizes(some.column(1)), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), n_tokens], ["doc_id", "n_tokens"])
        if not keep_words:
            encoder.cache_clear()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_tokens long")


def _segments(tokenizer_path: str, end_id: int, segment_tokens: int):
    def segment(part: int, number: int, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        columns = [[part], [number], [len(sizes)], [len(ids)], [doc_ids.to_pylist()], [sizes], [pack(ids)]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = [f.split()[0] for f in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, ids, sizes = pa.array([], pa.int64()), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                some = batch.slice(at, DOCS_AT_ONCE)
                more, lengths = encoder(tokenizer_path).encode(some.column(1))
                doc_ids = pa.concat_arrays([doc_ids, some.column(0)])
                ids = np.concatenate([ids, np.insert(more, np.cumsum(lengths), end_id)])
                sizes = np.concatenate([sizes, lengths + 1])
                while len(ids) >= segment_tokens:
                    n = int(np.searchsorted(np.cumsum(sizes), segment_tokens)) + 1
                    tokens = int(sizes[:n].sum())
                    yield segment(part, number, doc_ids[:n], ids[:tokens], sizes[:n])
                    doc_ids, ids, sizes, number = doc_ids[n:], ids[tokens:], sizes[n:], number + 1
        if len(sizes):
            yield segment(part, number, doc_ids, ids, sizes)

    return write


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Write the ids of all documents (doc_id long, text, ...), each closed by end_id, in ascending doc_id order.

    A null text is an empty one; rows without doc_id come first, rows that repeat a doc_id follow one another by text. A
    segment ends with the document that fills it. The order of parts, segments and documents is that of doc_id.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    segments = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(
        _segments(tokenizer_path, end_id, segment_tokens), SEGMENTS
    )
    segments.write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes = Segment(row["payload"]).ids().astype("<u4")
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            starts = ends - np.array(row["lengths"], np.int64)
            held = memoryview(codes)
            sums = [zlib.crc32(held[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["segment"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents: (doc_id, start, n_tokens, ids_crc32), start being the number of ids before the document.

    Only the sizes of parts and segments are added up, in two steps: parts over all files, segments within their part.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    before_part = parts.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    in_part = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    before = sizes.select("part", "segment", in_part.alias("earlier")).join(before_part, "part")
    schema = "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    return (
        segments.select("part", "segment", "doc_ids", "lengths", "payload")
        .mapInArrow(_documents, schema)
        .join(before, ["part", "segment"])
        .select("doc_id", (F.col("before") + F.col("earlier") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_at(spark: SparkSession, path: str, place: int) -> int:
    """The id at a place of the whole stream: one segment is read, and of it one id.

    Sizes are added up over parts first, then over the segments of one part.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", "segment", "n_tokens")

    def reached(rows: DataFrame, name: str, before: int):
        """The first of rows (name, n_tokens) in order whose end lies behind the place."""
        ends = rows.withColumn("end", F.sum("n_tokens").over(Window.orderBy(name)) + before)
        return ends.filter(F.col("end") > place).orderBy("end").first()

    part = reached(sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")), "part", 0)
    found = part and reached(sizes.filter(F.col("part") == part["part"]), "segment", part["end"] - part["n_tokens"])
    if place < 0 or found is None:
        raise IndexError(place)
    row = segments.filter((F.col("part") == found["part"]) & (F.col("segment") == found["segment"]))
    return Segment(row.first()["payload"])[place - (found["end"] - found["n_tokens"])]
