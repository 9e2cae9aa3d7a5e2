"""What the physical plans must look like, and joins under heavy keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from schemalign.operators import skew, tfidf
from schemalign.plans.field_match import field_match


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0}])
def test_matcher_plan(spark, options):
    names = spark.range(50).selectExpr("concat('order ', id, ' date') AS input_field")
    dictionary = spark.range(40).selectExpr("concat('date ', id) AS src", "concat('T', id % 7) AS target")
    text = plan(field_match(names, dictionary, **options))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert text.count("ArrowEvalPython [sequence_ratio") == 1
    assert "WindowGroupLimit" in text


def test_heavy_keys_are_split_and_nothing_is_lost(spark, monkeypatch):
    left = spark.range(3000, numPartitions=12).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert [r["n"] for r in skew.heavy_keys(left, ["k"], 100, "n").collect()] == [10]
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
        assert sorted(map(tuple, skew.salted_lookup(left, right, ["k"], how, 100).collect()), key=repr) == want
        for most, per_task in ((1 << 30, 100), (0, 100), (0, 10_000)):
            monkeypatch.setattr(skew, "BROADCAST_BYTES", most)
            monkeypatch.setattr(skew, "ROWS_PER_TASK", per_task)
            assert sorted(map(tuple, skew.looked_up(left, right, ["k"], how).collect()), key=repr) == want


def test_a_side_dealt_by_its_key_is_split_all_the_same(spark):
    left = spark.range(3000).select(F.lit(0).alias("k"), "id").repartition(8, "k")
    salts = left.withColumn("salt", skew._salt(left, ["k"], F.lit(10))).groupBy("salt").count().collect()
    assert len(salts) == 10 and max(r["count"] for r in salts) < 400


def test_grid_join(spark):
    left = spark.range(300, numPartitions=6).select((F.col("id") % 5 * F.col("id")).alias("k"), F.col("id").alias("l"))
    right = spark.range(200, numPartitions=4).select((F.col("id") % 4 * F.col("id")).alias("k"), F.col("id").alias("r"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, skew.salted_grid_join(left, right, "k", 7).collect())) == want


@pytest.mark.parametrize("least", [0.05, 0.3, 0.7])
def test_sparse_cosine_finds_every_pair(spark, least):
    words = ["order", "date", "id", "customer", "name"]
    keys = spark.range(120).select(
        F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 4), lambda i: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", i), F.lit(5)).cast("int"))), " ").alias("key")
    ).distinct()
    vocabulary = tfidf.cap_vocabulary(tfidf.fit_terms(keys.withColumn("copies", F.lit(1).cast("bigint"))))
    vectors = {r["key"]: {e["term"]: e["weight"] for e in r["entries"]} for r in tfidf.weigh(keys, vocabulary).collect()}
    want = {}
    for a, va in vectors.items():
        for b, vb in vectors.items():
            cosine = sum(w * vb.get(t, 0.0) for t, w in va.items())
            if cosine >= least:
                want[a, b] = pytest.approx(cosine)
    got = {(r["input_key"], r["src_key"]): r["cosine"] for r in tfidf.sparse_cosine(keys, keys, vocabulary, least, 11).collect()}
    assert got == want


def test_settled_files_can_be_dropped(spark):
    from pathlib import Path

    from schemalign.operators import settle

    held = settle._written[:]
    settle._written.clear()
    kept = settle.settle(spark.range(3))
    path = Path(settle._written[0])
    assert kept.count() == 3 and path.exists() and settle.drop_settled(spark) == 1 and not path.exists()
    settle._written[:] = held


def _shuffles(df) -> list[str]:
    df.collect()
    text = plan(df)
    final = text[: text.find("Initial Plan")] if "Initial Plan" in text else text
    return [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line and "BroadcastExchange" not in line]


@pytest.mark.parametrize("most, shuffles", [(1 << 30, 2), (0, 4)])
def test_upsert_has_few_shuffles(spark, monkeypatch, most, shuffles):
    from schemalign.operators import dictionary

    monkeypatch.setattr(skew, "BROADCAST_BYTES", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.range(50).selectExpr("id % 7 AS k", "'x' AS v")
        done = dictionary.upsert(base, spark.range(10).selectExpr("id AS k", "'y' AS v"), ["k"], ["v"])
        assert len(_shuffles(done)) <= shuffles and sorted(map(tuple, done.collect()))[-1] == (9, "y")
        gone = dictionary.delete_keys(base, spark.range(3).selectExpr("id AS k"), ["k"])
        assert plan(gone).count("Range (0, 50") <= 1 or not most
        assert gone.count() == 28
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_match_view_shows_the_names_as_they_are(spark):
    from schemalign.plans.field_match import match_view

    spark.createDataFrame([("Order Date", "Date")], "src string, target string").createOrReplaceTempView("known_names")
    for names, want in ((["order-date", "zzz"], ["order-date"]), (["Order date!"], ["Order date!"])):
        listed = ", ".join(f"'{n}'" for n in names)
        spark.sql(f"SELECT explode(array({listed})) AS input_field").createOrReplaceTempView("asked_names")
        match_view(spark, "asked_names", "known_names", "found_names")
        assert [r["input_field"] for r in spark.sql("SELECT * FROM found_names").collect()] == want
