"""Reply trees: root-to-leaf paths, ranked by score, each formatted as one conversation.

Paths are found by self-joins that double their reach: after k rounds each message knows its 2^k-th
ancestor and the score on the way there, so a chain of a million replies takes twenty rounds. Rounds work on
ids only and are written to the shared folder. Texts are joined once, to the paths that were chosen.

The template marks a turn as ``### role: text</turn>`` and a line feed. Inside texts and roles a backslash is doubled, and
the control strings ``### `` and ``</turn>`` are written ``\\h`` and ``\\t`` (in roles also ``: `` as ``\\c``), so that a
mark is always the template's own and :func:`read_turn` gives back what was written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from httplens.operators.ordered import number_rows
from httplens.session import stage

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
_ESCAPES = (("\\", "\\\\"), (OPEN, "\\h"), (CLOSE, "\\t"))
_ROLE_ESCAPES = (*_ESCAPES, (MIDDLE, "\\c"))
_MEANING = {"\\\\": "\\", "\\h": OPEN, "\\t": CLOSE, "\\c": MIDDLE}
_TURN = re.compile(r"### (.*?): (.*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\[\\htc]")


def escaped(text: Column, role: bool = False) -> Column:
    for plain, written in _ROLE_ESCAPES if role else _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(segment)
    if not found:
        raise ValueError(f"not one turn: {segment[:80]!r}")
    role, text = (_ESCAPED.sub(lambda m: _MEANING[m.group()], part) for part in found.groups())
    return role, text


# --- paths -------------------------------------------------------------------------------


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The jumps of 1, 2, 4, ... steps up, and per node its depth and the score from it to the root.

    Nodes on a cycle, and below one, never reach a root and are not in the second table.
    """
    jumps = stage(nodes.select("node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "jumps")
    levels, most = [], jumps.count()
    while True:
        open_ends = jumps.where("up IS NOT NULL")
        if open_ends.isEmpty() or 1 << len(levels) > most:
            return levels, jumps.where("up IS NULL").select("node", "total", F.col("steps").alias("depth"))
        levels.append(open_ends.select("node", "up"))
        above = jumps.select(
            F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        jumps = stage(jumps.join(above, "up", "left").select(
            "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps")), "jumps")


def _placed(tree: str, parent: str, score: str | None) -> Column:
    """Parent and score of a message. Of messages that share an id the one with the least of both, then role and text, counts."""
    up = F.when(F.col(parent).isNotNull(), F.struct(F.col(tree).alias("tree"), F.col(parent).alias("id")))
    return F.struct(up.alias("up"), F.coalesce(F.col(score).cast("double") if score else F.lit(0.0), F.lit(0.0)).alias("score"))


def branches(
    messages: DataFrame, tree: str, node: str, parent: str, score: str | None = None, top: int | None = 1,
) -> DataFrame:
    """The ``top`` paths of each tree (all for None): tree, node, ``rank``, ``path_score``, ``position`` from 1.

    A path runs from a root (no parent, or one that is not there) to a leaf. Its score is the mean of its messages'
    scores (null as 0); ties go to the smaller leaf. Node ids are unique within a tree; of repeated ones one row is kept, that
    with the least parent (none first), score, role and text.
    Trees may have a null id. Messages on a cycle, or replies to one, have no path.
    """
    key = F.struct(F.col(tree).alias("tree"), F.col(node).alias("id"))
    own = messages.select(key.alias("node"), _placed(tree, parent, score).alias("m"))
    own = stage(own.groupBy("node").agg(F.min("m").alias("m")).select("node", "m.up", "m.score"), "nodes")
    there = own.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    nodes = own.join(there, "up", "left").select(
        "node", F.when(F.col("there"), F.col("up")).alias("up"), "score")
    levels, reached = _levels(nodes)

    leaves = reached.join(nodes.where("up IS NOT NULL").select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    ranked = leaves.select("node", "depth", (F.col("total") / F.col("depth")).alias("path_score"))
    ranked = ranked.withColumn("rank", F.row_number().over(
        Window.partitionBy("node.tree").orderBy(F.desc("path_score"), "node.id")).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    paths = ranked.select("node", F.col("node").alias("leaf"), "rank", "path_score", "depth", F.lit(0).cast("long").alias("back"))
    for k, level in enumerate(levels):
        further = paths.join(level, "node").select(
            F.col("up").alias("node"), "leaf", "rank", "path_score", "depth", (F.col("back") + (1 << k)).alias("back"))
        paths = stage(paths.unionByName(further), "paths")
    return paths.select(
        F.col("node.tree").alias(tree), F.col("node.id").alias(node), "rank", "path_score",
        (F.col("depth") - F.col("back")).alias("position"))


# --- formatting ------------------------------------------------------------------------------


def formatted(
    messages: DataFrame, tree: str, node: str, parent: str, role: str = "role", text: str = "text",
    score: str | None = None, top: int | None = 1, learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn of each chosen path: tree, ``rank``, ``position``, ``segment``, ``loss_start``, ``loss_end``.

    A conversation is its segments in order of ``position``. The loss mask of a segment is the span of code points
    [loss_start, loss_end) of the escaped text where the role is in ``learn``; empty otherwise. Null roles and texts
    count as empty.
    """
    chosen = branches(messages, tree, node, parent, score, top)
    key = F.struct(F.col(tree).alias("tree"), F.col(node).alias("id"))
    said = messages.select(
        key.alias("_key"), _placed(tree, parent, score).alias("_place"), F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"))
    said = said.groupBy("_key").agg(F.min(F.struct("_place", "_role", "_text")).alias("m")).select("_key", "m._role", "m._text")
    turns = chosen.withColumn("_key", key).join(said, "_key")
    head = F.concat(F.lit(OPEN), escaped(F.col("_role"), role=True), F.lit(MIDDLE))
    body = escaped(F.col("_text"))
    learned = F.col("_role").isin(*learn)
    return turns.select(
        tree, "rank", "path_score", "position", F.concat(head, body, F.lit(CLOSE + "\n")).alias("segment"),
        F.char_length(head).alias("loss_start"),
        (F.char_length(head) + F.when(learned, F.char_length(body)).otherwise(0)).alias("loss_end"))


def conversations(segments: DataFrame, tree: str) -> DataFrame:
    """Each path as one text, with the spans of its loss mask. A row holds its whole conversation."""
    turn = F.struct("position", "segment", "loss_start", "loss_end")
    joined = segments.groupBy(F.struct(tree).alias("_tree"), "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    ends = F.aggregate(
        "turns", F.array().cast("array<int>"),
        lambda seen, t: F.concat(seen, F.array(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + F.char_length(t["segment"]))))
    spans = F.transform("turns", lambda t, i: F.struct(
        (F.get("ends", i) - F.char_length(t["segment"]) + t["loss_start"]).alias("start"),
        (F.get("ends", i) - F.char_length(t["segment"]) + t["loss_end"]).alias("end")))
    return joined.withColumn("ends", ends).select(
        f"_tree.{tree}", "rank", F.array_join(F.col("turns.segment"), "").alias("text"),
        F.filter(spans, lambda s: s["end"] > s["start"]).alias("loss"))


# --- reading back ------------------------------------------------------------------------------


def _digested(batches: Iterator[pa.RecordBatch], tree_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (tree, rank, position, segment, loss_start, loss_end) in order; only digests are held, not texts."""
    current, state = None, None

    def new():
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "learned": 0, "chars": 0}

    def row(name, s):
        return [name, s["n"], s["turns"].hexdigest(), s["learned"], s["loss"].hexdigest(), s["chars"]]

    names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [tree_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for tree, rank, _, segment, start, end in zip(*columns):
            if state is None or (tree, rank) != current:
                if state is not None:
                    out.append(row(current[0], state))
                current, state = (tree, rank), new()
            role, text = read_turn(segment)
            state["n"] += 1
            state["turns"].update(f"{role}\n{text}\n".encode())
            learned = _ESCAPED.sub(lambda m: _MEANING[m.group()], segment[start:end])
            state["loss"].update(learned.encode())
            state["learned"] += len(learned)
            state["chars"] += len(segment)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(current[0], state), kinds)], names)


def digests(segments: DataFrame, tree: str) -> DataFrame:
    """Per conversation what a reader finds in it: turns, learned text, size.

    A digest needs its text in order; a task reads a conversation turn by turn and holds none of it.
    """
    rows = segments.select(tree, "rank", "position", "segment", "loss_start", "loss_end")
    kind = segments.schema[tree].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    ordered = rows.repartition(tree, "rank").sortWithinPartitions(tree, "rank", "position")
    return ordered.mapInArrow(
        lambda b: _digested(b, arrow),
        f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).withColumnRenamed("tree", tree)


def chains(turns: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """Turns of plain conversations as reply trees: ``node_id`` in order of ``order``, ``parent_id`` the turn before."""
    numbered = number_rows(turns, [conversation, *[o for o in order if o != conversation]], "node_id", unique=False)
    numbered = stage(numbered, "turns")
    first = numbered.groupBy(F.struct(conversation).alias("_tree")).agg(F.min("node_id").alias("_first"))
    joined = numbered.withColumn("_tree", F.struct(conversation)).join(first, "_tree")
    return joined.withColumn("parent_id", F.when(F.col("node_id") > F.col("_first"), F.col("node_id") - 1)).drop("_tree", "_first")
