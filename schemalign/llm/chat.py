"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, each chosen one written as one conversation.

Template: <|im_start|>ROLE, line end, TEXT, <|im_end|>, line end, for every turn. Inside roles and texts, '<|' becomes '<\\|'
and every further backslash between the two characters gets one more, so no text can hold a control string and the
original comes back. Line ends and backslashes of a role are written as \\n and \\\\ first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemalign.operators.settle import settle

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) turns -> the formatted conversation and the (start, end) spans of it that are learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_learned(formatted: str, spans: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def chains(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> messages of trees without branches: every row answers the one before it.

    Rows go by turn, then role and text, nulls first; so rows that repeat a turn follow each other. Rows without conv_id
    belong to no conversation and are left out.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("tree_id"),
        place.alias("msg_id"),
        F.when(place > 1, place - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(None).cast("double").alias("score"),
    )


def _climb(steps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Self-joins that double the height: tables of (tree_id, msg_id, up), up being 2**k replies higher, and totals.

    Only messages that have not reached their root are joined again, so long conversations do not burden short ones.

    totals: (tree_id, msg_id, score) of messages that reach a root, with the scores of the whole path added up. A message
    in a circle of replies, or below one, has none.
    """
    state = steps.withColumnRenamed("parent_id", "up").select("tree_id", "msg_id", "up", "score")
    heights, most = [], steps.count()
    while True:
        higher = state.filter("up IS NOT NULL")
        if 2 ** len(heights) > 2 * max(most, 1) or higher.isEmpty():
            return heights, state.filter("up IS NULL").select("tree_id", "msg_id", "score")
        heights.append(higher.select("tree_id", "msg_id", "up"))
        above = state.select("tree_id", F.col("msg_id").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        risen = higher.join(above, ["tree_id", "up"]).select(
            "tree_id", "msg_id", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score")
        )
        state = settle(risen.unionByName(state.filter("up IS NULL")))


def _each_once(messages: DataFrame) -> DataFrame:
    """messages with every msg_id once in its tree; where none is repeated, which ids alone tell, they are left as they are."""
    keys = ["tree_id", "msg_id"]
    ids = messages.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    if ids.filter("rows > 1").isEmpty():
        return messages
    rest = ["parent_id", "role", "text", "score"]
    least = messages.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least"))
    return least.select(*keys, *[F.col(f"least.{c}").alias(c) for c in rest])


def chosen_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages (tree_id, msg_id, parent_id, role, text, score, ...) -> (tree_id, leaf_id, rank, depth, role, text).

    A message whose parent is not in its tree is a root. A branch's score is the sum of its messages' (null: 0); the best
    so many branches of a tree are chosen (None: all), of equal ones those with the smaller leaf. Only ids and scores are
    joined repeatedly, on (tree, message), so one huge tree spreads over all tasks; texts join once, for chosen paths.
    Messages without tree_id or msg_id are left out, as nothing can refer to them. Of messages that repeat a msg_id in
    their tree one counts: the least by parent, role, text and score, nulls first.
    """
    messages = _each_once(messages)
    own = settle(messages.select("tree_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score")).dropna(subset=["tree_id", "msg_id"]))
    ids = own.select("tree_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    steps = settle(
        own.join(ids, ["tree_id", "parent_id"], "left").select(
            "tree_id", "msg_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), "score"
        )
    )
    heights, totals = _climb(steps)
    answered = steps.select("tree_id", F.col("parent_id").alias("msg_id")).dropna().distinct()
    leaves = totals.join(answered, ["tree_id", "msg_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "msg_id"))
    leaves = leaves.withColumn("rank", rank)
    if best is not None:
        leaves = leaves.filter(F.col("rank") <= best)
    path = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), "rank", "msg_id", F.lit(0).cast("long").alias("below"))
    for k in reversed(range(len(heights))):
        higher = path.join(heights[k], ["tree_id", "msg_id"]).select(
            "tree_id", "leaf_id", "rank", F.col("up").alias("msg_id"), (F.col("below") + 2**k).alias("below")
        )
        path = path.unionByName(higher)
        if k % 4 == 0:
            path = settle(path)
    texts = messages.select("tree_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return path.join(texts, ["tree_id", "msg_id"]).select("tree_id", "leaf_id", "rank", (-F.col("below")).alias("depth"), "role", "text")


def _rows(make: Callable[[dict], tuple], schema: T.StructType, names: list[str]):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(row) for row in batch.select(names).to_pylist()]
            kept = [batch.column(f.name) for f in schema.fields[: len(schema) - len(made[0])]] if made else []
            columns = [pa.array(c, arrow.field(len(kept) + k).type) for k, c in enumerate(zip(*made, strict=True))]
            if made:
                yield pa.RecordBatch.from_arrays([*kept, *columns], schema=arrow)

    return run


def format_conversations(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages as for chosen_paths -> (tree_id, leaf_id, rank, formatted string, loss array of (start, end)).

    One row per chosen path. loss holds the spans of formatted, in code points, that are to be learned: the texts of
    assistant turns without the marks around them. Null roles and texts are empty ones.
    """
    turn = F.struct("depth", "role", "text")
    paths = chosen_paths(messages, best).groupBy("tree_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    keys = [paths.schema[c] for c in ("tree_id", "leaf_id", "rank")]
    schema = T.StructType([*keys, T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])

    def made(row: dict) -> tuple:
        text, spans = format_turns([(t["role"], t["text"]) for t in row["turns"]])
        return text, [{"start": a, "end": b} for a, b in spans]

    return paths.mapInArrow(_rows(made, schema, ["turns"]), schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: numbers and hashes of their turns and learned texts."""
    import hashlib

    keys = [formatted.schema["tree_id"]]
    fields = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([*keys, *[T.StructField(n, k) for n, k in fields]])

    def made(row: dict) -> tuple:
        turns = read_turns(row["formatted"])
        learned = read_learned(row["formatted"], [(s["start"], s["end"]) for s in row["loss"]])
        said = hashlib.sha256()
        for role, text in turns:
            said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        loss = hashlib.sha256(learned.encode("utf-8", "surrogatepass"))
        return len(turns), said.hexdigest(), len(learned), loss.hexdigest(), len(row["formatted"])

    return formatted.select("tree_id", "formatted", "loss").mapInArrow(_rows(made, schema, ["formatted", "loss"]), schema)
