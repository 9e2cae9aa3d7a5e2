"""Reply trees and the template."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from schemalign.llm import chat

hostile = st.text(st.sampled_from("<|\\\n>n aim_startend"), max_size=40) | st.sampled_from([chat.END, chat.START, "<\\|im_end|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "x\\n", "<|im_end|>"]) | hostile, hostile), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert chat.read_learned(formatted, spans) == "".join(t for r, t in turns if r == "assistant")


def plain_paths(messages):
    """Every root-to-leaf path by following parents, as {tree: [(score, leaf, [ids])]}."""
    trees = {}
    for tree in {m[0] for m in messages}:
        own = {m[1]: m for m in messages if m[0] == tree}
        parents = {m[2] for m in own.values()}
        for leaf in own:
            path, at = [], leaf
            while at in own and len(path) <= len(own):
                path.append(at)
                at = own[at][2]
            if leaf not in parents and len(path) <= len(own):
                trees.setdefault(tree, []).append((sum(own[i][5] or 0 for i in path), leaf, path[::-1]))
    return trees


def test_best_branches(rows):
    messages = [
        (1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0),
        (1, 4, 2, "user", "c", 2.5), (1, 5, 3, "user", "d", 0.5), (1, 6, 3, "user", None, 0.5), (1, 7, 99, "user", "lost", 0.1),
        (2, 1, 2, "user", "circle", 9.0), (2, 2, 1, "user", "circle", 9.0), (2, 3, 2, "user", "below", 9.0),
        (3, 1, None, None, "", None), (None, 1, None, "user", "nowhere", 1.0),
        *[(4, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)],
    ]
    schema = "tree_id long, msg_id long, parent_id long, role string, text string, score double"
    df = rows(messages, schema).selectExpr("*", "1 AS rank", "2 AS up")
    known = {(m[0], m[1]): (m[3] or "", m[4] or "") for m in messages}
    want = {t: sorted(p, key=lambda x: (-x[0], x[1])) for t, p in plain_paths([m for m in messages if m[0] is not None]).items()}
    for best in (2, None):
        got = {(r.tree_id, r.rank): (r.leaf_id, chat.read_turns(r.formatted)) for r in chat.format_conversations(df, best).collect()}
        assert got == {
            (t, k + 1): (leaf, [known[t, i] for i in path])
            for t, paths in want.items()
            for k, (_, leaf, path) in enumerate(paths[:best])
        }


def test_conversations_are_chains(rows):
    data = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "z"), (None, 1, "user", "x")]
    df = rows(data, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(chat.chains(df)).collect()
    assert [(r.tree_id, chat.read_turns(r.formatted)) for r in got] == [(1, [("", "z"), ("user", ""), ("user", ""), ("assistant", "b")])]
    empty = rows([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(chat.chains(empty))).collect() == []


def test_messages_that_repeat_an_id(spark):
    schema = "tree_id long, msg_id long, parent_id long, role string, text string, score double"
    tree = [(1, 1, None, "user", "a", 1.0), (1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "c", 9.0), (1, 3, 2, "user", "d", None)]
    found = chat.chosen_paths(spark.createDataFrame(tree + tree[:2], schema), None).orderBy("leaf_id", "depth").collect()
    assert [(r.leaf_id, r.rank, r.text) for r in found] == [(3, 1, "a"), (3, 1, "b"), (3, 1, "d")]
