from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from schemalign.functions import text
from schemalign.functions.sequence import sequence_ratio
from schemalign.operators import names


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    values = [" Clé_No./X  é-b ", None, "???", "a b\tc\n", "Ärger-ß_9", "", "ünï…cødé"]
    assert column(spark, values, text.normalize_name) == ["clé_no x é b", "", "", "a b c", "ärger ß_9", "", "ünï cødé"]


def test_normalize_twice_is_once(spark):
    values = ["A--b", "  x_Y ", "é.É", "1/2"]
    once = column(spark, values, text.normalize_name)
    assert column(spark, once, text.normalize_name) == once


def test_table_name(spark):
    values = ["my file-2024.v2.csv", "2024.csv", "_x.csv", "plain", "", "é.csv", "a" * 200]
    want = ["MY_FILE_2024_V2", "T_2024", "T__X", "PLAIN", "", "T__", "A" * 128]
    assert column(spark, values, text.table_name) == want


def test_bands(spark):
    df = spark.createDataFrame([(0.8,), (0.79999,), (0.5,), (0.49,)], "s double")
    assert [r[0] for r in df.select(text.confidence_band(F.col("s"))).collect()] == ["High", "Medium", "Medium", "Low"]


def test_ngrams(spark):
    df = spark.createDataFrame([("a big red bolt",), ("x",), ("",)], "v string")
    toks = df.select(text.tokens(F.col("v")).alias("toks"))
    got = [r[0] for r in toks.select(text.word_ngrams("toks")).collect()]
    assert got == [["big", "red", "bolt", "big red", "red bolt", "big red bolt"], [], []]


def test_sequence_ratio_is_difflib(spark):
    rng = random.Random(3)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(make(rng.randint(0, 12), "abc "), make(rng.randint(0, 12), "abc ")) for _ in range(300)]
    pairs += [(make(150, "abcdef"), make(rng.randint(190, 420), "abcdefgh")) for _ in range(40)]
    pairs += [("a" * 250, "a" * 250), ("", ""), (None, "x"), ("x", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").repartition(5)
    for row in df.withColumn("r", sequence_ratio("a", "b")).collect():
        a, b = pairs[row["i"]]
        want = None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
        assert row["r"] == want


def test_shared_characters_bounds_the_ratio(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices("abé c", k=rng.randint(0, 9))), "".join(rng.choices("abé c", k=rng.randint(0, 9)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("most", text.shared_characters("a", "b"))
    for a, b, most in df.collect():
        assert sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) <= most
        assert most == sum(min(a.count(c), b.count(c)) for c in set(a))


def test_name_list(spark):
    df = spark.createDataFrame([(1, "b\n a \n\nb"), (2, ""), (3, None)], "list_id int, typed string")
    got = names.parse_name_list(df, "typed", ["c", "a"]).orderBy("list_id", "pos").collect()
    assert [r["input_field"] for r in got if r["list_id"] == 1] == ["b", "a", "c"]
    assert [r["input_field"] for r in got if r["list_id"] == 2] == ["c", "a"]


@pytest.mark.parametrize("fields", [["a", "b", "a"], []])
def test_explode_inputs(spark, fields):
    df = spark.createDataFrame([(fields,)], "input_fields array<string>")
    assert [tuple(r) for r in names.explode_inputs(df).collect()] == list(enumerate(fields))
