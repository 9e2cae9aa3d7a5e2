"""The kept index and the matcher as an SQL function: what field_match gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from schemalign.operators import characters
from schemalign.operators import dictionary as kept
from schemalign.plans import match_index
from schemalign.plans.field_match import SCORES, field_match
from schemalign.plans.match_index import apply_changes, build_index, create_match_function

WORDS = ["order", "date", "customer", "name", "total", "amt", "no", "id", "a", "ship"]
COLUMNS = ("input_field", "src_field", "target_field", *SCORES, "match_rank")


def names(draw, n):
    made = []
    for _ in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randint(1, 4))]
        if draw.random() < 0.4:
            k = draw.randrange(len(words))
            words[k] = words[k][: max(1, len(words[k]) - 1)] + draw.choice("xyz")
        made.append(draw.choice([" ", "_", "-"]).join(words))
    return made


def called(spark, asked, top_n, threshold, function="field_match"):
    listed = ", ".join("NULL" if a is None else f"'{a}'" for a in asked)
    rows = spark.sql(f"SELECT * FROM {function}(array({listed}), {top_n}, {threshold}D)").collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr)


def matched(spark, asked, dictionary, top_n, threshold):
    inputs = spark.createDataFrame([(a,) for a in asked], "input_field string")
    rows = field_match(inputs, dictionary, top_n, threshold).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr)


@pytest.mark.parametrize("top_n, threshold", [(3, 0.1), (1, 0.14), (10, 0.3), (2, 0.75)])
def test_same_as_field_match(spark, top_n, threshold):
    draw = random.Random(11)
    rows = [(s, draw.choice("ABCD")) for s in names(draw, 60)] + [("", "E"), (None, "F"), ("order date", None), ("order date", "B"), ("Order  Date", "C")]
    rows += [(" ".join(names(draw, 12)), "L") for _ in range(4)]
    dictionary = spark.createDataFrame(rows + rows[:5], "src string, target string")
    create_match_function(build_index(dictionary, "ix_same"))
    asked = [*names(draw, 25), "", None, "zzz", "Order-Date", "Order-Date", "a", " ".join(names(draw, 12)), rows[-1][0][:80]]
    assert called(spark, asked, top_n, threshold) == matched(spark, asked, dictionary, top_n, threshold)


def test_defaults_arrays_from_tables_and_limits(spark):
    dictionary = spark.createDataFrame([("Order Date", "When"), ("ORDER_DT", "When"), ("Total", "Sum")], "src string, target string")
    create_match_function(build_index(dictionary, "ix_small"), "match_small")
    spark.createDataFrame([("order-date",), ("ttl",)], "name string").createOrReplaceTempView("asked_for")
    found = spark.sql("SELECT * FROM match_small((SELECT collect_list(name) FROM asked_for))")
    assert found.columns == list(COLUMNS)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == matched(spark, ["order-date", "ttl"], dictionary, 3, 0.1)
    assert spark.sql("SELECT * FROM match_small(cast(array() AS array<string>))").count() == 0
    for wrong in ("11, 0.1D", "3, 0.05D"):
        with pytest.raises(Exception, match="the index answers"):
            spark.sql(f"SELECT * FROM match_small(array('x'), {wrong})").collect()


def test_dictionary_without_terms_and_an_empty_one(spark):
    letters = spark.createDataFrame([(" ".join(w), "T") for w in ("abc", "abd", "xyz", "a", "bca", "")], "src string, target string")
    create_match_function(build_index(letters, "ix_letters"), "match_letters")
    asked = ["a b c", "abc", "x", "b a c d", ""]
    assert called(spark, asked, 3, 0.1, "match_letters") == matched(spark, asked, letters, 3, 0.1)
    create_match_function(build_index(letters.limit(0), "ix_none"), "match_none")
    assert called(spark, asked, 3, 0.1, "match_none") == []


def test_index_after_changes_equals_one_built_anew(spark):
    draw = random.Random(4)
    old = [(s, draw.choice("AB"), "") for s in names(draw, 50)] + [("order date", "A", ""), ("order date", "B", ""), ("order date", "B", "")]
    new = [r for r in old if draw.random() < 0.7 or r[0] == "order date"] + [(s, "C", "") for s in names(draw, 20)]
    new = [r for r in new if r[:2] != ("order date", "B")]
    schema = "src string, target string, description string"
    old_df, new_df = (spark.createDataFrame(x, schema) for x in (old, new))
    index = build_index(old_df.select("src", "target"), "ix_kept")
    create_match_function(index, "match_kept")
    postings = index.table("facts").first()["postings"]
    diff = kept.snapshot_diff(old_df, new_df)
    after = kept.apply_diff(old_df, diff)
    apply_changes(index, diff)
    assert index.table("facts").first()["postings"] == postings
    asked = [*names(draw, 20), "order date", "a"]
    assert called(spark, asked, 3, 0.1, "match_kept") == matched(spark, asked, after.select("src", "target"), 3, 0.1)
    anew = build_index(after.select("src", "target"), "ix_anew")
    for side, keys in (("vocabulary", ["term", "idf"]), ("terms", ["term", "tf", "df"]), ("entries", ["src", "target", "n"])):
        same = [sorted(map(tuple, i.table(side).select(*keys).filter("true").collect()), key=repr) for i in (index, anew)]
        assert same[0] == same[1], side
    apply_changes(index, kept.snapshot_diff(new_df, old_df))  # names that come back are posted already
    assert index.table("postings").groupBy("probe", "key").count().filter("count > 1").count() == 0


def test_calls_join_written_postings(spark):
    dictionary = spark.range(300).select(F.concat(F.lit("order "), "id", F.lit(" date")).alias("src"), F.lit("T").alias("target"))
    create_match_function(build_index(dictionary, "ix_plan"), "match_plan")
    plan = spark.sql("SELECT * FROM match_plan(array('order 7 dat', 'x'))")._jdf.queryExecution().executedPlan().toString()
    assert "ix_plan_postings" in plan and "CartesianProduct" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_buckets_follow_the_names(spark, monkeypatch):
    few = spark.createDataFrame([("order date", "A"), ("total", "B")], "src string, target string")
    index = build_index(few, "ix_buckets")
    assert index.table("facts").first()["buckets"] == 1  # not as many as are shuffled into
    monkeypatch.setattr(match_index, "KEYS_PER_TASK", 4)
    more = [(n, "C") for n in dict.fromkeys(names(random.Random(8), 40))]
    grown = spark.createDataFrame([("order date", "A"), *more], "src string, target string").dropDuplicates(["src"])
    apply_changes(index, kept.snapshot_diff(few.withColumn("description", F.lit("")), grown.withColumn("description", F.lit(""))))
    facts = index.table("facts").first()
    assert 4 < facts["buckets"] <= 8
    for side in (facts["postings"], "ix_buckets_postings"):
        assert spark.table(side).filter("probe = 'x:order date'").count() == 1
    create_match_function(index, "match_buckets")
    asked = ["Order-Date", "total", "custmer nam", "zzz"]
    assert called(spark, asked, 3, 0.1, "match_buckets") == matched(spark, asked, grown, 3, 0.1)


def broadcast(plan):
    """The subtrees of a plan's text that are broadcast."""
    lines = plan.splitlines()
    depths = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith("BroadcastExchange"):
            end = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_names_asked_for_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(match_index, "KEYS_PER_TASK", 4)
    draw = random.Random(6)
    dictionary = spark.createDataFrame([(n, "T") for n in dict.fromkeys(names(draw, 40))], "src string, target string")
    index = build_index(dictionary, "ix_merged")
    create_match_function(index, "match_merged")
    spark.createDataFrame([(n,) for n in names(draw, 30)], "name string").createOrReplaceTempView("asked_merged")
    found = spark.sql("SELECT * FROM match_merged((SELECT collect_list(name) FROM asked_merged))")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()  # as it ended and as it began
    sent = list(broadcast(plan))
    assert sent and all("posexplode" not in s and "ix_merged_names" not in s and "ix_merged_postings" not in s for s in sent)
    assert index.table("facts").first()["buckets"] > 1 and "out of 1\n" not in plan and " out of 1)" not in plan


@pytest.mark.parametrize("run_names, block_names", [(3, 16), (1, 5)])
def test_open_names_in_runs_and_blocks(spark, monkeypatch, run_names, block_names):
    monkeypatch.setattr(match_index, "_RUN_NAMES", run_names)
    monkeypatch.setattr(characters, "RIGHT_NAMES", block_names)
    draw = random.Random(7)
    made = ["".join(draw.choice("abcde") for _ in range(draw.randint(3, 8))) for _ in range(60)]
    dictionary = spark.createDataFrame([(n, draw.choice("AB")) for n in made[:40]], "src string, target string")
    create_match_function(build_index(dictionary, "ix_runs"), "match_runs")
    asked = [*made[30:], "", "order"]
    rows = matched(spark, asked, dictionary, 3, 0.1)
    assert len(rows) > 40 and called(spark, asked, 3, 0.1, "match_runs") == rows
    plan = spark.sql("SELECT * FROM match_runs(array('abcd'))")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "REPARTITION_BY_NUM" in plan.split("hashpartitioning(block")[-1].splitlines()[0]
