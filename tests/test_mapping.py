from __future__ import annotations

from schemalign.operators import answers as a
from schemalign.operators import mapping as m
from schemalign.operators.conform import layouts

SUGGESTED = "source_id string, position int, input_field string, target string, score double, src_match string"
COLUMNS = "source_id string, position int, src_col string"
MAPPING = "source_id string, position int, src_col string, target string"


def test_exact_name_wins_over_folded(spark):
    suggestions = spark.createDataFrame(
        [("f", 0, "Dob", "X", 0.9, "s1"), ("f", 1, "dob", "Y", 0.8, "s2"), ("f", 2, "DOB", "Z", 0.7, "s3")], SUGGESTED
    )
    columns = spark.createDataFrame([("f", 0, "Dob"), ("f", 1, "dob"), ("f", 2, "DoB"), ("g", 0, "dob")], COLUMNS)
    got = {(r["source_id"], r["src_col"]): r["target"] for r in m.suggestion_for(columns, suggestions).collect()}
    assert got == {("f", "Dob"): "X", ("f", "dob"): "Y", ("f", "DoB"): "Z", ("g", "dob"): None}


def test_select_mapping(spark):
    suggestions = spark.createDataFrame(
        [("f", 0, "a", "A", 0.3, "s"), ("f", 1, "b", "B", 0.2999, "s"), ("f", 2, "c", "unknown", 1.0, "s")], SUGGESTED
    )
    columns = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c"), ("f", 3, "d")], COLUMNS)
    targets = spark.createDataFrame([("A",), ("B",)], "target string")
    got = {r["src_col"]: (r["target"], r["src_match"]) for r in m.select_mapping(columns, suggestions, targets).collect()}
    assert got == {"a": ("A", "s"), "b": ("(Ignored)", None), "c": ("(Ignored)", None), "d": ("(Ignored)", None)}


def test_duplicates_and_gate(spark):
    mapping = spark.createDataFrame(
        [
            ("f", 0, "a", "X"), ("f", 1, "b", "X"), ("f", 2, "c", "(Ignored)"), ("f", 3, "d", "(Ignored)"),
            ("g", 0, "a", "X"), ("g", 1, "c", "(Ignored)"), ("h", 0, "a", "(Ignored)"),
        ],
        MAPPING,
    )
    assert sorted(tuple(r) for r in m.duplicate_targets(mapping).collect()) == [("f", "X", 0, "a", 2), ("f", "X", 1, "b", 2)]
    others = sorted(tuple(r) for r in m.also_mapped_by(mapping, mapping).collect())
    assert others == [("f", 0, "a", "X", 1, 1, "b"), ("f", 1, "b", "X", 1, 0, "a")]
    summary = {r["source_id"]: tuple(r)[1:] for r in m.mapping_summary(mapping).collect()}
    assert summary == {"f": (2, 2, 4, 1, False), "g": (1, 1, 2, 0, True), "h": (0, 1, 1, 0, False)}
    assert sorted((r["source_id"], r["positions"]) for r in layouts(mapping, ["W", "X"]).collect()) == [("f", [None, 0]), ("g", [None, 0])]
    counts = {tuple(r) for r in m.status_counts(m.mapped_ignored(mapping)).collect()}
    assert counts == {("f", "Mapped", 2), ("f", "Ignored", 2), ("g", "Mapped", 1), ("g", "Ignored", 1), ("h", "Ignored", 1)}


def test_wide_files_are_told_in_full(spark):
    mapping = spark.range(2500).selectExpr("'f' AS source_id", "CAST(id AS int) AS position", "concat('c', id) AS src_col", "'X' AS target")
    got = m.duplicate_targets(mapping).collect()
    assert len(got) == 2500 and {r["n_columns"] for r in got} == {2500}
    others = m.also_mapped_by(mapping, mapping.filter("position = 999")).collect()
    assert sorted(r["other_position"] for r in others) == [k for k in range(2500) if k != 999]
    assert {r["n_others"] for r in others} == {2499}


def test_answer(spark):
    text = (
        'text {"p": {"target":"A","confidence":0.6}, "q": {"target":"A","confidence":0.9}, "r": "B", "s": "NONE", '
        '"t": {"target":"Z"}}'
    )
    responses = spark.createDataFrame(
        [("f", text), ("g", "no braces"), ("h", '{"a": {"target"}'), ("i", None), ("j", '{"Q":\n"B"}')],
        "source_id string, response string",
    )
    targets = spark.createDataFrame([("A",), ("B",)], "target string")
    got = {(r["source_id"], r["input_field"], r["target"], r["score"], r["src_match"]) for r in a.resolve_responses(responses, targets).collect()}
    assert got == {("f", "q", "A", 0.9, "LLM"), ("f", "r", "B", 0.5, "LLM"), ("j", "Q", "B", 0.5, "LLM")}
    status = {r["source_id"]: r["status"] for r in a.response_status(responses).collect()}
    assert status == {
        "f": "ok", "g": "no_json", "h": "bad_json", "i": "no_response", "j": "ok"
    }
    columns = spark.createDataFrame([("j", 0, "q")], COLUMNS)
    folded = m.select_mapping(columns, a.resolve_responses(responses, targets), targets).first()
    assert (folded["target"], folded["score"]) == ("B", 0.5)


def test_prompts(spark):
    columns = spark.createDataFrame([("f", 1, "b"), ("f", 0, "a"), ("f", 2, "c"), ("g", 0, "x")], COLUMNS)
    targets = spark.createDataFrame([("T",), ("S",), ("T",)], "target string")
    prompts = a.build_prompts(columns, targets, "{{x}}\n{source_list}|{target_list}", per_prompt=2)
    got = {(r["source_id"], r["block"]): r["prompt"] for r in prompts.collect()}
    assert got == {("f", 0): "{x}\n- a\n- b|- S\n- T", ("f", 1): "{x}\n- c|- S\n- T", ("g", 0): "{x}\n- x|- S\n- T"}
    answered = a.complete(prompts, lambda p: '{"a": "S"}' if "- a" in p else None)
    assert [r["source_id"] for r in a.resolve_responses(answered, targets).collect()] == ["f"]


def test_of_repeated_members_the_last_counts(spark):
    responses = spark.createDataFrame([("f", '{"a":"1","b":"2","a":"2"}'), ("g", '{"a":"1"}')], "source_id string, response string")
    got = sorted(tuple(r) for r in a.parse_mapping(responses).collect())
    assert got == [("f", 0, "a", "2", 0.5), ("f", 1, "b", "2", 0.5), ("g", 0, "a", "1", 0.5)]
    targets = spark.createDataFrame([("1",), ("2",)], "target string")
    assert [(r["source_id"], r["input_field"]) for r in a.resolve_responses(responses, targets).orderBy("source_id").collect()] == [("f", "a"), ("g", "a")]


def test_blocks_keep_the_order_of_answers(spark):
    responses = spark.createDataFrame([("f", 1, '{"z":"T"}'), ("f", 0, '{"y":"N", "zz":"T"}')], "source_id string, block long, response string")
    targets = spark.createDataFrame([("T",)], "target string")
    assert [r["input_field"] for r in a.resolve_responses(responses, targets).collect()] == ["zz"]


def test_a_failing_call_leaves_the_others(spark):
    prompts = spark.createDataFrame([("f", 0, "ok"), ("g", 0, "bad"), ("h", 0, "none")], "source_id string, block long, prompt string")

    def answer(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return "fine" if prompt == "ok" else None

    got = sorted((r["source_id"], r["response"], r["error"]) for r in a.complete(prompts, answer).collect())
    assert got == [("f", "fine", None), ("g", None, "RuntimeError: down"), ("h", None, None)]


def test_unknown_placeholder(spark):
    import pytest

    with pytest.raises(KeyError):
        a.build_prompts(spark.createDataFrame([], COLUMNS), spark.createDataFrame([("T",)], "target string"), "{other}").collect()
