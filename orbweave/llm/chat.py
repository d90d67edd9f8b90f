"""Chat formatting of reply trees.

Paths from leaves to roots are enumerated by self-joins that double their reach in each
round: a pointer from each message to its ancestor 1, 2, 4, ... replies up extends the
known part of every path.  Branches are ranked by the sum of their messages' scores,
and each chosen path becomes one conversation in a template with a loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import staged, tune

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: str) -> str:
    """Makes a text safe between marks: afterwards it holds no ``<|``.  Reversible."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans (code points) that the loss covers:
    exactly the escaped texts of the loss role."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def reply_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of ``nodes(tree, node, parent, score)``.

    Returns ``tree, leaf, rank, node, dist`` with ``dist`` replies between node and leaf, for the
    ``branches`` best paths of each tree (None: all), ranked by the sum of scores, of equal
    sums by the larger leaf.  Of rows that repeat a node, whatever their tree, the smallest by tree, parent and
    score counts, null first; a row without node is left out.  A parent that is null or
    unknown makes a root; a null score counts as 0; nodes that reply to each other in a
    circle, and those that reply to them, have no root and no path.  The number of rounds is
    the logarithm of the longest path; where there are circles, that of the number of nodes,
    over those alone that lead into one.  Scores are summed along the pointers, so that only the paths that are
    asked for are ever listed."""
    kind = nodes.schema["tree"].dataType.simpleString()
    own = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("tree", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("o"))
    nodes = staged(own.select(F.col("o.tree").cast(kind).alias("tree"), "node", "o.parent", "o.score"), "nodes")
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    # Of each node how far it points, null once that is past its root, and the scores up to there.
    pointers = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("up"), "score")
    parents = pointers.select(F.col("up").alias("node")).filter("node IS NOT NULL").distinct()
    levels, reach, n_nodes = [], 1, nodes.count()
    while True:
        pointers = staged(pointers, "pointers")
        if reach > n_nodes or pointers.filter("up IS NOT NULL").isEmpty():
            break  # what still points after as many steps as there are nodes has no root
        levels.append((reach, pointers.filter("up IS NOT NULL").select("node", "up")))
        other = pointers.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        ahead = pointers.filter("up IS NOT NULL").join(other, "up").select("node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        pointers = pointers.filter("up IS NULL").unionAll(ahead)
        reach *= 2
    leaves = nodes.select("tree", "node").join(parents, "node", "left_anti")
    scored = leaves.join(pointers.filter("up IS NULL").select("node", "score"), "node").select("tree", F.col("node").alias("leaf"), "score")
    if branches == 1:
        best = scored.groupBy("tree").agg(F.max(F.struct("score", "leaf")).alias("best")).select("tree", "best.leaf", F.lit(1).alias("rank"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("leaf"))
        best = scored.withColumn("rank", F.row_number().over(order))
        best = (best if branches is None else best.filter(F.col("rank") <= branches)).select("tree", "leaf", "rank")
    paths = staged(best.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).alias("dist")), "paths")
    for reach, pointers in levels:
        further = paths.join(pointers, "node").select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist"))
        paths = staged(paths.union(further), "paths")
    return paths


def format_paths(paths: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formats each path as one conversation: ``tree, leaf, rank, formatted, loss``.

    ``messages(node, role, text)`` holds the texts; a null role or text counts as empty, and of rows that
    repeat a node the smallest by role and text counts.
    A conversation is one row, so its turns meet in one place; ``loss`` is an array of
    (start, end) in code points of ``formatted``."""
    tune(paths.sparkSession)
    turn = F.struct((-F.col("dist")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = paths.join(messages.select("node", "role", "text"), "node").groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tree, leaf = (paths.schema[c].dataType.simpleString() for c in ("tree", "leaf"))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for k, t in enumerate(turns) if not k or t["at"] != turns[k - 1]["at"]], loss_role) for turns in batch.column(3).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t for t, _ in made], pa.string()), spans], names=["tree", "leaf", "rank", "formatted", "loss"])

    return whole.mapInArrow(form, f"tree {tree}, leaf {leaf}, rank int, formatted string, loss array<struct<start:bigint,end:bigint>>")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats linear conversations: each turn replies to the one before it.

    Returns ``conv, formatted, loss``, a row for each conversation.  Turns that repeat a
    number follow each other in the order of role and text, null first; turns without a
    conversation id are one conversation of their own.  An empty table gives no rows."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    rows = rows.withColumn("at", place)
    own = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))  # no id looks like none
    name = lambda at: F.concat_ws(":", own, at.cast("string"))
    rows = staged(rows.select("conv", name(F.col("at")).alias("node"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score")), "turns")
    paths = reply_paths(rows.select(F.col("conv").alias("tree"), "node", "parent", "score"))
    return format_paths(paths, rows).select(F.col("tree").alias("conv"), "formatted", "loss")


def conversation_digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back: number and digest of the turns, length and
    digest of all text under the loss mask, unescaped, and the formatted length."""
    kind = formatted.schema["conv"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, loss_n, loss_sha, size = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                n.append(len(turns)), size.append(len(text)), loss_n.append(len(loss))
                sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(loss_n, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv", "formatted", "loss").mapInArrow(digest, f"`{id_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
