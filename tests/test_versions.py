"""Published versions, landing of any layout, answers that are kept."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from schemalign.operators import answers, skew
from schemalign.operators import dictionary as d
from schemalign.sources import versions
from schemalign.streaming.landing import land_files, landed


def _base_exchanges(spark, change, name):
    """Exchanges of the plan of a change that stand above the scan of the base."""
    table = versions._properties(spark, name)["published.table"]
    done = change(spark.table(table))
    done.collect()
    lines = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    found = []
    for k, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
            above, now = [], depth[k]
            for j in range(k - 1, -1, -1):
                if depth[j] < now:
                    above.append(lines[j])
                    now = depth[j]
            found += [x for x in above if "Exchange" in x and "Broadcast" not in x]
    return found


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_upsert_of_a_published_table_leaves_the_base_in_place(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", most)
    name = f"published_{uuid.uuid4().hex[:8]}"
    base = spark.range(500).selectExpr("concat('s', id % 200) AS src", "concat('t', id % 3) AS target", "'old' AS description")
    versions.publish(base, name, ["src", "target"])
    updates = spark.range(100, 120).selectExpr("concat('s', id) AS src", "'t1' AS target", "'new' AS description")

    def change(table):
        return d.upsert(table, updates, ["src", "target"], ["description"])

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges = _base_exchanges(spark, change, name)
        assert len(exchanges) <= (1 if most else 0)  # the distinct keys that few updates are found under
        seen = spark.table(name)
        versions.republish(spark, name, change)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(tuple, change(base).collect()))
    assert sorted(map(tuple, spark.table(name).collect())) == want and ("s110", "t1", "new") in want
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, base.collect()))  # who began to read before sees the old version


def test_versions_follow_each_other(spark):
    name = f"published_{uuid.uuid4().hex[:8]}"
    tables = [versions.publish(spark.range(5).selectExpr("id AS k", "0 AS v"), name, ["k"], 3)]
    for n in range(1, 4):
        tables.append(versions.republish(spark, name, lambda base, n=n: base.filter(f"k <> {n}").withColumn("v", F.lit(n))))
    assert sorted(map(tuple, spark.table(name).collect())) == [(0, 3), (4, 3)]
    assert versions.drop_versions(spark, name, 1) == tables[:2]
    assert not spark.catalog.tableExists(tables[0]) and spark.table(tables[2]).count() == 3
    tables.append(versions.publish(spark.range(2).selectExpr("id AS k", "9 AS v"), name, ["k"]))
    assert spark.table(name).count() == 2 and versions.drop_versions(spark, name, 0) == tables[2:4]

    def broken(base):
        return base.withColumn("v", F.raise_error(F.lit("no")).cast("int"))

    with pytest.raises(Exception, match="no"):
        versions.republish(spark, name, broken)
    assert sorted(map(tuple, spark.table(name).collect())) == [(0, 9), (1, 9)]


def test_files_of_any_layout_land_once(spark, tmp_path):
    folder, path, parked, checkpoint = (str(tmp_path / n) for n in ("in", "out", "parked", "checkpoint"))
    (tmp_path / "in").mkdir()
    dictionary = spark.createDataFrame([("Order Date", "When"), ("ORDER_DT", "When"), ("Total", "Sum"), ("TOT", "Sum")], "src string, target string")

    def run():
        query = land_files(spark, folder, dictionary, checkpoint, path, parked, files_per_batch=2)
        query.awaitTermination()

    (tmp_path / "in" / "a.csv").write_text('Order Date,junk zz,Total\n2024,x,"1\n5"\nNA,y,2\n')
    (tmp_path / "in" / "b.txt").write_text("TOT|ORDER_DT\n7|2025\n")
    (tmp_path / "in" / "bad.csv").write_text("TOT,b\n1,2,3\n")
    run()
    want = [("2024", "1\n5"), (None, "2"), ("2025", "7")]
    assert sorted(map(tuple, landed(spark, path).select("When", "Sum").collect()), key=repr) == sorted(want, key=repr)
    (tmp_path / "in" / "c.csv").write_text("qqq\tzzz\n1\t2\n")
    (tmp_path / "in" / "d.csv").write_text("order date,Order-Date\n1,2\n")
    (tmp_path / "in" / "e.csv").write_text("ORDER DT\n2026\n")
    run()
    run()
    want.append(("2026", None))
    assert sorted(map(tuple, landed(spark, path).select("When", "Sum").collect()), key=repr) == sorted(want, key=repr)
    reasons = {r["source_id"].split("/")[-1]: r["reason"] for r in landed(spark, parked).collect()}
    assert reasons == {"bad.csv": "a row has 3 fields, the header 2", "c.csv": "nothing mapped", "d.csv": "a target is claimed twice"}


def test_a_repeated_batch_replaces_what_it_wrote(spark, tmp_path):
    folder, path, parked, checkpoint = (str(tmp_path / n) for n in ("in", "out", "parked", "checkpoint"))
    (tmp_path / "in").mkdir()
    dictionary = spark.createDataFrame([("Total", "Sum")], "src string, target string")
    (tmp_path / "in" / "a.csv").write_text("Total\n1\n")
    land_files(spark, folder, dictionary, checkpoint, path, parked).awaitTermination()
    for name in ("0", ".0.crc"):  # as if the run had ended before it was noted down
        (tmp_path / "checkpoint" / "commits" / name).rename(tmp_path / f"commit{name}")
    land_files(spark, folder, dictionary, checkpoint, path, parked).awaitTermination()
    assert [tuple(r) for r in landed(spark, path).select("Sum").collect()] == [("1",)]


def test_a_failing_run_continued_asks_each_prompt_once(spark, tmp_path):
    log, fuse, store = tmp_path / "log", tmp_path / "fuse", str(tmp_path / "store")
    log.mkdir()
    fuse.write_text("")
    prompts = spark.range(40).selectExpr("id AS source_id", "0L AS block", "concat('p', id % 30) AS prompt")
    folder, switch = str(log), str(fuse)

    def answer(prompt):
        import os
        import uuid

        if prompt == "p7" and os.path.exists(switch):
            raise SystemExit("the machine goes away")
        open(os.path.join(folder, f"{prompt}-{uuid.uuid4().hex}"), "w").close()
        if prompt == "p9":
            raise ValueError("no")
        return prompt.upper()

    with pytest.raises(Exception, match="."):
        answers.complete_kept(prompts, answer, store, per_task=1, in_flight=2).collect()
    fuse.unlink()
    found = {r["source_id"]: (r["response"], r["error"]) for r in answers.complete_kept(prompts, answer, store, per_task=1).collect()}
    assert found == {k: (None, "ValueError: no") if k % 30 == 9 else (f"P{k % 30}", None) for k in range(40)}
    asked = [p.name.split("-")[0] for p in log.iterdir()]
    kept = [p for p in set(asked) if p not in ("p7", "p9")]
    assert set(asked) == {f"p{k}" for k in range(30)}
    assert sum(asked.count(p) for p in kept) <= len(kept) + 8  # tasks under way when the run failed may be asked again
    before = len(list(log.iterdir()))
    answers.complete_kept(prompts, answer, store).collect()
    assert len(list(log.iterdir())) == before + 1  # the failing one only


def test_upsert_of_a_version_by_the_keys_of_dictionaries(spark, monkeypatch):
    """Updates too many to be sent, keys as the library names them."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    schema = "src string, target string, description string"
    base = spark.createDataFrame([("a", "A", "1"), ("a", "A", "2"), ("b", "B", "3"), ("c", "C", "4")], schema)
    updates = spark.createDataFrame([("a", "A", "x"), ("n", "N", "y")], schema)
    versions.publish(base, "by_keys", d.KEYS)
    versions.republish(spark, "by_keys", lambda held: d.upsert(held, updates, d.KEYS, ["description"]))
    versions.republish(spark, "by_keys", lambda held: d.delete_keys(held, base.filter("src = 'b'")))
    found = sorted(tuple(r) for r in spark.table("by_keys").collect())
    assert found == [("a", "A", "x"), ("a", "A", "x"), ("c", "C", "4"), ("n", "N", "y")]
