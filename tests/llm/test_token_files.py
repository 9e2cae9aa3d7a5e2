"""Token files: round trips and access to single ids."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from schemalign.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_every_id_is_read_alone(ids):
    segment = token_files.Segment(token_files.pack(np.array(ids, np.uint32)))
    assert segment.ids().tolist() == ids and [segment[i] for i in range(len(segment))] == ids
    with pytest.raises(IndexError):
        segment[len(ids)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\t \x1cab'sé1.<|>") , max_size=30))
def test_words_are_encoded_as_in_whole_texts(text):
    texts = [text, "plain words", text + "x", "", text.strip()]
    encoder = token_files.encoder(PATH)
    ids, sizes = encoder.encode(pa.array(texts))
    assert [x.tobytes() for x in np.split(ids, np.cumsum(sizes))[:-1]] == encoder._plain(texts)


def test_added_tokens_are_found_as_by_the_untouched_library():
    untouched = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|>", "one two<|endoftext|>three four", "plain words", "a <|endoftext|> b", "<|endoftext |>"]
    ids, sizes = token_files.Encoder(PATH).encode(pa.array(texts))
    want = [untouched.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == want and want[0] == [50256]


def test_other_tokenizers_encode_whole_texts():
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, sizes = encoder.encode(pa.array(["A b  c", None]))
    assert not encoder.by_word and ids.tobytes() == encoder._plain(["A b  c"])[0] and sizes.tolist() == [len(ids), 0]


def test_files(spark, rows, tmp_path):
    texts = {5: "hello  world", 1: None, 3: "", 9: "é" * 4000 + " end", 2: "<|endoftext|> x", None: "first", 8: " lead\n\n trail "}
    data = [(i, t, "x") for i, t in texts.items()] + [(5, "hello again", "y")]
    token_files.write_tokens(rows(data, "doc_id long, text string, start string"), str(tmp_path / "t"), PATH, 2, segment_tokens=5)
    plain = token_files.encoder(PATH)
    want, stream = [], []
    for i, t, _ in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.frombuffer(plain._plain([t or ""])[0], "<u4").tolist() + [2]
        want.append((i, len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
    got = token_files.read_documents(spark, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert [token_files.token_at(spark, str(tmp_path / "t"), k) for k in (0, 7, len(stream) - 1)] == [stream[k] for k in (0, 7, -1)]
    with pytest.raises(IndexError):
        token_files.token_at(spark, str(tmp_path / "t"), len(stream))


def test_empty_table(spark, rows, tmp_path):
    token_files.write_tokens(rows([], "doc_id long, text string"), str(tmp_path / "t"), PATH, 2)
    assert token_files.read_documents(spark, str(tmp_path / "t")).collect() == []


def test_counting_leaves_no_tokenizer_behind(spark, rows):
    docs = rows([(1, "some words here"), (2, None)], "doc_id long, text string").coalesce(1)

    def kept(batches):
        counted = [{"doc_id": batch.column(0), "n_tokens": batch.column(1)} for batch in batches]
        found = token_files.encoder.cache_info().currsize
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(c["doc_id"]) for c in counted)]), pa.array([found])], ["docs", "found"])

    # One process does both: what counting leaves is seen by what comes after it in the same task.
    after = token_files.count_tokens(docs, PATH, keep_words=False).mapInArrow(kept, "docs long, found long")
    assert [(r["docs"], r["found"]) for r in after.collect()] == [(2, 0)]
