from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from schemalign.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """(role, text) -> WHOLE, CUT or GONE, by the plain rules."""
    found, seen = [], set()
    for role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        if not signs:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows):
    """Every way to edit a short conversation: (cost, audit, repaired)."""
    told = faults(rows)
    inserted = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    for each in itertools.product("KudD", repeat=len(rows)):  # u, d: given role user, assistant
        kept = []
        for way, (role, text), fault in zip(each, rows, told, strict=True):
            if way != "D" and fault in ("blank", "duplicate"):
                break
            kept.append((way, role, text, fault))
        else:
            for puts in itertools.product(inserted, repeat=len(rows) + 1):
                cost, audit, out = 0, "", []
                for put, row in itertools.zip_longest(puts, kept):
                    cost, audit = cost + 2 * len(put), audit + "I" * len(put)
                    out += [(r, "") for r in put]
                    if row is None:
                        continue
                    way, role, text, fault = row
                    cost += {"K": 0, "D": 3}.get(way, 2) + (fault == "truncated" and way != "D")
                    audit += {"u": "R", "d": "R"}.get(way, way)
                    if way != "D":
                        out.append(({"u": "user", "d": "assistant"}.get(way, role), text))
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                    best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def plain(rows, **limits):
    fixed = repair.repair(rows, **limits)
    report = {r["conv_id"]: r.asDict() for r in fixed.report.collect()}
    turns = {}
    for p in sorted(fixed.pieces.collect(), key=lambda p: (p["part"], p["block"])):
        turns.setdefault(p["conv_id"], []).extend((m["role"], m["text"]) for m in p["messages"])
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(fixed.pieces).collect()}
    return report, turns, hashes


def test_short_conversations_against_every_way_to_edit(rows):
    draw = random.Random(5)
    told = {}
    for conv in range(90):
        texts = ["Yes.", "no", " ", "Why?", "Yes."]
        told[conv] = [(draw.choice(["user", "assistant", "system", "tool", "user"]), draw.choice(texts)) for _ in range(draw.randint(1, 3))]
    given = [(c, k, *row) for c, said in told.items() for k, row in enumerate(said)]
    report, turns, hashes = plain(rows(given, SCHEMA))
    for conv, said in told.items():
        cost, audit, out = cheapest(said)
        assert (report[conv]["cost"], report[conv]["audit"], turns[conv]) == (cost, audit, out), said
        assert hashes[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        told_faults = faults(said)
        for name in ("blank", "duplicate", "truncated"):
            assert report[conv][name] == told_faults.count(name)
        initials = [r[:1] for r, _ in said]
        assert report[conv]["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))


def test_long_conversations_in_blocks_equal_whole_ones(spark):
    draw = random.Random(8)
    said = [(1, k, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"So {k}.", f"then {k}", "", "Well."])) for k in range(400)]
    others = [(c, k, draw.choice(["user", "assistant"]), f"Text {k}.") for c in range(2, 30) for k in range(5) if draw.random() < 0.8]
    df = spark.createDataFrame(said + others, SCHEMA).repartition(3)
    blocks = plain(df, block_rows=7)
    for c in (1, *range(2, 30)):
        own = [r[2:] for r in sorted(r for r in said + others if r[0] == c)]
        kinds = [(role[:1], {"blank": repair.GONE, "duplicate": repair.GONE, "truncated": repair.CUT, "": repair.WHOLE}[f]) for (role, _), f in zip(own, faults(own), strict=True)]
        reached, audits = repair.solve(kinds)
        cost, _, node, closing = repair._closed(reached, audits)
        audit = "".join(audits.path(node)) + closing
        assert (blocks[0][c]["cost"], blocks[0][c]["audit"]) == (cost, audit)
        assert blocks[1][c] == repair.edited(own, audit)
        assert blocks[2][c] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in blocks[1][c]).encode()).hexdigest()


def test_turns_gaps_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, part long, duplicate string, _row int, rows string, block int"
    extra = (1, "x", 2, "y", 3)
    given = [(1, None, "user", "Hm.", *extra), (1, 3, "user", "A?", *extra), (1, 7, "assistant", "B.", *extra), (1, 7, "user", "C.", *extra)]
    given += [(2, None, "user", "A.", *extra), (3, -(2**62), "user", "A.", *extra), (3, 2**62, "assistant", "B.", *extra)]
    report, turns, _ = plain(spark.createDataFrame(given, schema))
    assert {c: r["gaps"] for c, r in report.items()} == {1: 3, 2: 0, 3: 2**63 - 1}
    cost, audit, out = cheapest([("user", "Hm."), ("user", "A?"), ("assistant", "B."), ("user", "C.")])
    assert (report[1]["cost"], report[1]["audit"], turns[1]) == (cost, audit, out)


def test_nulls_long_texts_repeats_and_no_rows(spark):
    long = "word " * 400_000 + "."
    given = [(None, 1, "user", "Hello."), (None, 2, None, "Hi."), (4, 1, "user", None), (5, 1, "user", long), (5, 2, "assistant", long)]
    given += [(6, 1, "user", "Same."), (6, 2, "assistant", "Yes.")] + [(6, 2, "assistant", "Yes.")] * 50 + [(7, 1, "", "x.")]
    report, turns, hashes = plain(spark.createDataFrame(given, SCHEMA))
    assert turns[None] == [("user", "Hello."), ("assistant", "Hi.")] and report[None]["audit"] == "KR"
    assert (report[4]["audit"], report[4]["cost"], report[4]["blank"]) == ("D", 3, 1)
    assert hashes[4] == hashlib.sha256(b"").hexdigest()
    assert turns[5] == [("user", long), ("assistant", long)] and report[5]["cost"] == 0
    assert (report[6]["duplicate"], report[6]["cost"], turns[6]) == (50, 150, [("user", "Same."), ("assistant", "Yes.")])
    assert report[7]["audit"] == "D"
    report, turns, hashes = plain(spark.createDataFrame([], SCHEMA))
    assert not report and not turns and not hashes


@pytest.mark.parametrize("modulus", [2, 3, 7])
def test_collisions_of_hashes_are_found_out(modulus):
    draw = random.Random(modulus)
    audits = repair.Audits(base=1, modulus=modulus)
    nodes = [(0, "")]
    for _ in range(40):
        nodes = [(audits.add(n, x), text + x) for n, text in nodes for x in draw.sample(["K", "R", "D", "IK"], 2)]
        nodes = list({t: (n, t) for n, t in draw.sample(nodes, min(6, len(nodes)))}.values())
    for (a, x), (b, y) in itertools.permutations(nodes, 2):
        assert audits.less(a, "", b, "") == (x < y)


def test_repeated_messages_are_told_by_a_join_as_by_a_broadcast(spark, monkeypatch):
    given = [(c, k, ("user", "assistant")[k % 2], "Same." if k > 1 else f"Text {k}.") for c in range(20) for k in range(6)]
    df = spark.createDataFrame(given, SCHEMA)
    sent = plain(df)
    monkeypatch.setattr(repair, "BROADCAST_ROWS", 0)
    assert plain(df) == sent
    assert sent[0][3]["duplicate"] == 2


def test_planted_damage(spark):
    given = [(c, k, "assistant", "One. Two! Three?") for c in range(60) for k in range(4)] + [(None, None, None, None)]
    import zlib

    expected = []
    for c, k, role, text in given:
        key = f"{' ' if c is None else c}:{' ' if k is None else k}"
        role, text = role or " ", text or " "
        match zlib.crc32(key.encode()) % 20:
            case 0:
                continue
            case 1:
                text = ""
            case 2:
                text = re.sub(r"[.!?]", "", text)
            case 3:
                expected.append((c, k, role, text))
            case 4:
                role = "user"
        expected.append((c, k, role, text))
    found = [tuple(r) for r in repair.damaged(spark.createDataFrame(given, SCHEMA)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
