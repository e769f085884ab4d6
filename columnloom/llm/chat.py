r"""Chat formatting of reply trees.

Messages form trees by their parent. Iterated self-joins double each message's ancestor pointer, which gives depth, path
score and root in ``log2(depth)`` rounds; each round is a staged table. Leaves are ranked per tree by the sum of the
scores on their path (then by length, then by id). For the chosen leaves the same pointer tables, read from the largest
jump down, enumerate the messages on the path, each exactly once. Each path becomes one conversation:

    <s>role \n text</s><s>role \n text</s>...

Control strings inside texts and roles get one more backslash behind their first character (``</s>`` becomes ``<\/s>``,
``<\/s>`` becomes ``<\\/s>``), which reading takes off again, so no text can end a turn and any text survives. The loss
mask is the list of spans of the assistant texts in the formatted string.

Texts travel once, to the rows of chosen paths; the rounds move ids only. A conversation is one output row and must fit
in memory, as any row must.

Edge cases: null role or text counts as empty; a missing parent makes a root; messages on a cycle of parents have no root
and are left out; repeated rows are messages of their own; messages of null tree ids form one tree per root; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columnloom.llm.common import pieces, staged, to_batch

#: The strings that mark turns here or in common templates.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_RISKY = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>", re.DOTALL)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _RISKY.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the [start, end) spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>{_escape_role(role)}\n", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, "</s>")
        at += len(head) + len(body) + 4
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    return [(_unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _pointer_tables(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, depth, path_score) of the nodes that reach a root, and the tables (node, up) for jumps of 1, 2, 4, ..."""
    state = staged(nodes.select("node", F.col("parent").alias("up"), F.lit(0).cast("long").alias("depth"), F.col("score").alias("path_score"), F.when(F.col("parent").isNull(), F.col("node")).alias("root")), "chat-up0")
    limit, tables = nodes.count().bit_length() + 1, []
    while state.where("up IS NOT NULL").limit(1).count() and len(tables) < limit:
        tables.append(state.where("up IS NOT NULL").select("node", "up"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("above"), F.col("path_score").alias("score_above"), "root")
        # depth counts once the pointer has passed the root; until then it is overwritten in each round.
        resting, moving = state.where("up IS NULL"), state.where("up IS NOT NULL").drop("root").join(above, "up")
        moved = moving.select("node", F.col("next").alias("up"), (F.col("above") + F.lit(1 << (len(tables) - 1))).alias("depth"), (F.col("path_score") + F.col("score_above")).alias("path_score"), "root")
        state = staged(resting.unionByName(moved), f"chat-up{len(tables)}")
    return state.where("up IS NULL").select("node", "root", "depth", "path_score"), tables


def _messages(messages: DataFrame) -> DataFrame:
    """tree, node, parent, role, text, score; a parent that is no node is dropped."""
    rows = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    return staged(rows, "chat-messages")


def format_reply_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, path_score, formatted, loss_spans array<struct<start,end>> for the best branches of each tree.

    ``messages``: tree, node (unique long), parent (long), role, text, score.
    """
    rows = _messages(messages)
    known = rows.select(F.col("node").alias("parent"))
    nodes = rows.select("tree", "node", "parent", "score").join(known.withColumn("known", F.lit(True)), "parent", "left")
    nodes = staged(nodes.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "chat-nodes")
    reached, tables = _pointer_tables(nodes)
    leaves = nodes.select("tree", "node").join(nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL"), "node", "left_anti").join(reached, "node")
    best = Window.partitionBy("tree", F.when(F.col("tree").isNull(), F.col("root"))).orderBy(F.desc("path_score"), F.desc("depth"), "node")
    chosen = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches) if branches else leaves
    path = staged(chosen.select("tree", F.col("node").alias("leaf"), "path_score", "node", F.lit(0).cast("long").alias("above")), "chat-path")
    for k in range(len(tables) - 1, -1, -1):
        further = path.join(tables[k], "node").select("tree", "leaf", "path_score", F.col("up").alias("node"), (F.col("above") + F.lit(1 << k)).alias("above"))
        path = staged(path.unionByName(further), "chat-path")
    turns = path.join(rows.select("node", "role", "text"), "node").groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("place"), "role", "text"))).alias("turns")
    )
    turns = turns.select("tree", "leaf", "path_score", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("path_score", pa.float64()), ("formatted", pa.string()), ("loss_spans", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns(list(zip(r.as_py(), t.as_py(), strict=True))) for r, t in zip(batch.column(3), batch.column(4), strict=True)]
            yield to_batch({"tree": batch.column(0), "leaf": batch.column(1), "path_score": batch.column(2), "formatted": [f for f, _ in done], "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in done]}, schema)

    return turns.mapInArrow(run, "tree long, leaf long, path_score double, formatted string, loss_spans array<struct<start:long,end:long>>")


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of conversations in rows by turn: each answers the row before it."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text")
    rows = staged(rows.withColumn("node", F.monotonically_increasing_id()), "chat-rows")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text", "node")
    return rows.select("tree", "node", F.lag("node").over(order).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read from the strings and spans alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "formatted"):
            out: dict[str, list] = {f.name: [] for f in schema}
            for tree, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_turns(text)
                loss = "".join([unescape(text[s["start"] : s["end"]]) for s in spans])
                row = (tree, len(turns), digest("".join([f"{r}\n{t}\n" for r, t in turns])), len(loss), digest(loss), len(text))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield to_batch(out, schema)

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
