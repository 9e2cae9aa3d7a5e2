from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from schemalign.operators import dictionary as d

SCHEMA = "src string, target string, description string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_diff(spark):
    old = spark.createDataFrame([("a", "A", ""), ("b", "B", "x")], SCHEMA)
    new = spark.createDataFrame([("b", "B", "y"), ("c", "C", None)], SCHEMA)
    assert rows(d.snapshot_diff(old, new)) == [
        ("a", "A", "", None, "delete"), ("b", "B", "x", "y", "update"), ("c", "C", None, "", "insert")
    ]


def test_diff_then_apply_gives_the_new_snapshot(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice("abcde"), rng.choice("ABC"), rng.choice(["", "x", "y", None])) for _ in range(n)]
    old = spark.createDataFrame(make(30), SCHEMA)
    new = spark.createDataFrame(make(30), SCHEMA).dropDuplicates(["src", "target"])
    applied = d.apply_diff(old.dropDuplicates(["src", "target"]), d.snapshot_diff(old.dropDuplicates(["src", "target"]), new))
    filled = lambda df: set(rows(df.withColumn("description", F.coalesce("description", F.lit("")))))
    assert filled(applied) == filled(new)


def test_upsert(spark):
    base = spark.createDataFrame([("a", "A", "1"), ("a", "A", "2"), ("b", "B", "3")], SCHEMA)
    updates = spark.createDataFrame([("a", "A", None), ("n", "N", "new")], SCHEMA)
    once = d.upsert(base, updates, ["src", "target"], ["description"])
    want = [("a", "A", None), ("a", "A", None), ("b", "B", "3"), ("n", "N", "new")]
    assert rows(once) == want
    assert rows(d.upsert(once, updates, ["src", "target"], ["description"])) == want


def test_upsert_by_single_key(spark):
    base = spark.createDataFrame([("APP", "x"), ("MODEL", "y")], "k string, v string")
    assert rows(d.upsert(base, spark.createDataFrame([("MODEL", "z")], "k string, v string"), ["k"], ["v"])) == [
        ("APP", "x"), ("MODEL", "z")
    ]


def test_upsert_refuses_two_updates_for_a_key(spark):
    base = spark.createDataFrame([("a", "A", "1")], SCHEMA)
    updates = spark.createDataFrame([("a", "A", "x"), ("a", "A", "y")], SCHEMA)
    with pytest.raises(PySparkException, match="several updates"):
        d.upsert(base, updates, ["src", "target"], ["description"]).collect()


def test_delete(spark):
    base = spark.createDataFrame([("a", "A", "1"), ("a", "A", "2"), ("a", "a", "3"), (None, "N", "4")], SCHEMA)
    pair = spark.createDataFrame([("a", "A")], "src string, target string")
    assert rows(d.delete_keys(base, pair)) == [("a", "a", "3"), (None, "N", "4")]
    assert d.deleted_count(base, pair).first()["deleted"] == 2
    source = spark.createDataFrame([("a",)], "src string")
    assert rows(d.delete_keys(base, source, ["src"])) == [(None, "N", "4")]
    assert rows(d.delete_keys(base, source, ["src"], protect_identity=True)) == [("a", "a", "3"), (None, "N", "4")]
    with pytest.raises(PySparkException, match="must not be NULL: src"):
        d.delete_keys(base, spark.createDataFrame([(None,)], "src string"), ["src"]).collect()


def test_insert_if_absent(spark):
    base = spark.createDataFrame([("a", "A", "1")], SCHEMA)
    new = spark.createDataFrame([("a", "A"), ("A", "A"), ("b", "B"), ("b", "B")], "src string, target string")
    assert rows(d.insert_if_absent(base, new)) == [("A", "A", None), ("a", "A", "1"), ("b", "B", None)]


def test_search_and_filter(spark):
    base = spark.createDataFrame([("Pat_Name", "A", None), ("DOB", "B", None), (None, "A", None)], SCHEMA)
    assert rows(d.search_src(base, "^pat|ob$"))[0][0] == "DOB" and d.search_src(base, "^pat|ob$").count() == 2
    assert d.search_src(base, "").count() == 3
    assert d.filter_targets(base, []).count() == 3 and d.filter_targets(base, ["A"]).count() == 2


def test_filtered_edit_touches_only_the_rows_shown(spark):
    base = spark.createDataFrame([("ab", "A", "1"), ("ab", "B", "2"), ("c", "A", "3"), (None, "A", "4")], SCHEMA)
    shown = (F.col("target") == "A") & d.source_matches("a")
    edited = spark.createDataFrame([("ab", "A", "new"), ("added", "A", "5")], SCHEMA)
    assert rows(d.merge_filtered_edit(base, shown, edited)) == rows(
        spark.createDataFrame([("ab", "A", "new"), ("added", "A", "5"), ("ab", "B", "2"), ("c", "A", "3"), (None, "A", "4")], SCHEMA)
    )


def test_stats(spark):
    base = spark.createDataFrame([("a", "A", None), ("a", "A", None), (None, "B", None), ("b", "B", None)], SCHEMA)
    assert tuple(d.dictionary_stats(base).first()) == (4, 2, 3)
    assert tuple(d.dictionary_stats(base.limit(0)).first()) == (0, 0, 0)
    assert rows(d.deletable_sources(base.unionByName(spark.createDataFrame([("B", "B", None)], SCHEMA)))) == [("a",), ("b",)]


def test_inserted_rows_are_given_ones(spark):
    base = spark.createDataFrame([], "src string, target string, x string, y string")
    new = spark.createDataFrame([("k", "K", "a", "z"), ("k", "K", "b", "y")], base.schema)
    assert [tuple(r) for r in d.insert_if_absent(base, new).collect()] == [("k", "K", "a", "z")]


def test_sources_without_target_can_be_deleted(spark):
    rows = spark.createDataFrame([("a", None), ("b", "b"), (None, "c")], "src string, target string")
    assert [r["src"] for r in d.deletable_sources(rows).collect()] == ["a"]
