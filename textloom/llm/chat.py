"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each formatted as one conversation.

Paths. Every message knows its parent. Iterative self-joins double the reach of each round: ``hops`` leads from a message
to its ancestor 2**i above, and joining a leaf's known ancestors with it doubles them, so depth d takes log2(d) rounds.
Paths of a tree are ranked by the mean score of their messages (then by length and leaf), and the best ``branches`` kept.
Messages on a cycle of parents, or under one, have no root and belong to no path. A parent that isn't there makes a root.

Template. ``<|im_start|>role`` newline, text, ``<|im_end|>`` newline. In roles and texts a backslash is doubled, and a
control string (the template's, or those of other common templates) gets a backslash after its first character, so no
text can open or close a turn, and dropping one backslash of each backslash pair gives the text back. The loss mask is a
list of spans: the text of each assistant turn.

Null texts and roles are empty. Rows of a conversation with equal turns go by role and text, repeated rows each count. A
null conversation id is a conversation of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

#: Control strings of common chat templates (fixed values).
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>")
OPEN, CLOSE = CONTROLS[:2]
_SPECIAL = re.compile("|".join(["\\\\", *map(re.escape, CONTROLS)]))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), mask


_HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a turn doesn't begin where the last one ends")
        head = _HEAD.match(formatted, at + len(OPEN))
        end = formatted.index(CLOSE, head.end())
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(CLOSE) + 1
    return turns


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """messages: tree, node, parent, score (parent null: root). Returns (tree, leaf, node, up) of the chosen paths."""
    scratch = Scratch(messages.sparkSession, "chat")
    nodes = scratch.write(messages.select("tree", "node", "parent", "score"), "nodes")
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    # a parent that isn't there is none
    hops = scratch.write(
        nodes.where("parent is not null").join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left_semi").select("tree", "node", F.col("parent").alias("above")), "hops-0"
    )
    inner = hops.select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    known = scratch.write(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "known-0")
    most, step = nodes.count(), 0
    while hops.head(1):
        via = hops.select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        joined = known.join(via, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        further = joined.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2**step).alias("up"))
        if 2**step > most:  # longer than any path: only cycles lead on
            endless = further.select(F.col("tree").alias("t"), F.col("leaf").alias("l")).distinct()
            known = known.join(endless, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_anti")
            break
        known = scratch.write(known.union(further), f"known-{step + 1}")
        hops = scratch.write(hops.join(via.toDF("t", "n", "top"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n"))).select("tree", "node", F.col("top").alias("above")), f"hops-{step + 1}")
        step += 1
    if branches is None:
        return known
    scored = known.join(nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    branch = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("length"))
    order = Window.partitionBy("tree").orderBy(F.desc_nulls_last("mean"), F.desc("length"), "leaf")
    best = branch.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= branches).select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return known.join(best, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column("turns").to_pylist():
            text, mask = render([(t["role"], t["text"]) for t in turns])
            texts.append(text)
            masks.append([{"start": a, "end": b} for a, b in mask])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("leaf"), pa.array(texts, pa.string()), pa.array(masks, kind)], names=["tree", "leaf", "formatted", "loss"])


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """messages: tree, node, parent, score, role, text. Returns (tree, leaf, formatted, loss spans) per chosen path."""
    small_batches(messages.sparkSession)
    chosen = paths(messages, branches)
    told = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chosen.join(told, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    kinds = dict(turns.dtypes)
    return turns.mapInArrow(_render, f"tree {kinds['tree']}, leaf {kinds['leaf']}, formatted string, loss array<struct<start: long, end: long>>")


def linear(conversations: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations without branches: each replies to the one before."""
    order = F.row_number().over(Window.partitionBy(tree).orderBy(turn, role, text)).cast("long")
    got = conversations.select(F.col(tree).alias("tree"), order.alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return got.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
