"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, as conversations.

A message has a parent of the same tree or none. Paths are enumerated with self-joins that double
their reach: after round ``k`` a message knows its ancestor ``2**k`` steps up and the summed score
of the messages between, so a tree of depth ``d`` takes ``log2(d)`` rounds of narrow integer rows.
Going back through the rounds from each chosen leaf, a join splits every known position into
itself and the one ``2**k`` above, which gives each position of the path exactly once. Text takes
part in the last join only. Everything is DataFrame functions.

A branch's score is the mean score of its messages (null counts as 0). ``branches`` of each tree
are formatted, best first, ties to the smaller leaf id; None formats all.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``<|`` becomes
``<\\|``, and every further backslash between the two signs keeps one more, so control strings
cannot arise from a text and escaping is reversible. Backslashes and line ends of roles become
``\\s`` and ``\\n``. The loss mask is a list of spans, in code points, over each assistant text.

Defined results: null texts and roles are empty; a message whose parent is null or missing starts
a tree branch of its own; rows that repeat a message id of a tree count once (the least row by
parent, role, text, score); messages with a null id are left out, a null tree id is a tree like
any other; messages behind a cycle of parents reach no root and are left out; an empty table gives
an empty result; columns not named take no part, whatever their names. One conversation is one
row, so its text is bounded by the size of a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manylabel.operators.ranks import head_per_group, with_rank
from manylabel.session import stage

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))
    return escape(one_line)


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    tail = len(END) + 1

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        size = F.length(piece) - F.length(role) - F.lit(1 + tail)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(piece.substr(F.length(role) + F.lit(2), size)).alias("text"),
        )

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(
        spans, lambda s: unescape(formatted.substr(s["start"] + F.lit(1), s["end"] - s["start"]))
    )


def _messages(messages: DataFrame, names: dict[str, str], unique: bool) -> DataFrame:
    """``(node, tree, message, parent, role, text, score)``, staged, each message once."""
    score = F.col(names["score"]).cast("double") if names.get("score") else F.lit(0.0)
    rows = messages.select(
        F.col(names["tree"]).alias("tree"), F.col(names["message"]).alias("message"),
        F.col(names["parent"]).alias("parent"),
        F.coalesce(F.col(names["role"]).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(names["text"]).cast("string"), F.lit("")).alias("text"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    ).filter(F.col("message").isNotNull())
    if not unique:
        least = F.min(F.struct("parent", "role", "text", "score")).alias("least")
        rows = rows.groupBy("tree", "message").agg(least).select("tree", "message", "least.*")
    return stage(rows.withColumn("node", F.monotonically_increasing_id()), "messages")


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``(node, jump)``, ancestors ``1, 2, 4, ...`` steps up, and ``(node, steps, total)`` of every
    whole path. Only messages that have not reached their root go on to the next round."""
    upper = nodes.select(F.col("tree").alias("tree_"), F.col("message").alias("message_"), F.col("node").alias("jump"))
    same = F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("parent") == F.col("message_"))
    first = nodes.join(upper, same, "left").select(
        "node", "jump", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")
    )
    at = stage(first, "jumps")
    levels, whole = [], at.filter("jump IS NULL")
    rounds = math.ceil(math.log2(max(nodes.count(), 1))) + 1
    while len(levels) <= rounds and not (going := at.filter("jump IS NOT NULL")).isEmpty():
        levels.append(going.select("node", "jump"))
        ahead = whole.unionByName(going).select(
            F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("steps").alias("more"), F.col("total").alias("gain")
        )
        at = stage(going.join(ahead, "jump").select(
            "node", F.col("next").alias("jump"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("gain")).alias("total")
        ), "jumps")
        whole = whole.unionByName(at.filter("jump IS NULL"))
    return levels, whole.select("node", "steps", "total")


def reply_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``(tree, branch, score, leaf, node, place)``: the messages of the chosen paths in order."""
    levels, whole = _jumps(nodes)
    leaves = nodes.select("node", "tree", "message")
    if levels:
        leaves = leaves.join(levels[0].select(F.col("jump").alias("node")), "node", "left_anti")
    leaves = leaves.join(whole, "node")
    scored = leaves.withColumn("score", F.col("total") / F.col("steps"))
    order = [F.col("score").desc(), F.col("message")]
    if branches is None:
        named = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
        chosen = with_rank(scored.withColumn("named", named), ["named"], order, "branch")
    else:
        chosen = head_per_group(scored, branches, ["tree"], order, "branch")
    paths = chosen.select(
        "tree", F.col("branch").cast("int").alias("branch"), "score", "steps", F.col("node").alias("leaf"), "node",
        F.lit(0).cast("long").alias("above"),
    )
    for k in reversed(range(len(levels))):
        here = F.struct(F.col("node").alias("node"), F.col("above").alias("above"))
        there = F.struct(F.col("jump").alias("node"), (F.col("above") + F.lit(1 << k)).alias("above"))
        both = F.when(F.col("jump").isNull(), F.array(here)).otherwise(F.array(here, there))
        paths = paths.join(levels[k], "node", "left").select(
            "tree", "branch", "score", "steps", "leaf", F.inline(both)
        )
    return paths.select(
        "tree", "branch", "score", "leaf", "node", (F.col("steps") - F.lit(1) - F.col("above")).alias("place")
    )


def format_trees(
    messages: DataFrame, tree: str = "tree_id", message: str = "message_id", parent: str = "parent_id",
    role: str = "role", text: str = "text", score: str | None = "score", branches: int | None = 1,
    unique: bool = False,
) -> DataFrame:
    """``(tree, branch, score, n_turns, formatted, loss_spans)`` of the best branches of each tree.

    ``loss_spans`` is ``array<struct<start, end>>``. ``unique`` says that no tree repeats a
    message id, which saves a grouping.
    """
    names = {"tree": tree, "message": message, "parent": parent, "role": role, "text": text, "score": score}
    nodes = _messages(messages, names, unique)
    turns = reply_paths(nodes, branches).join(nodes.select("node", "role", "text"), "node")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select(
        "tree", "branch", "score", "leaf", "place", head.alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learn"),
    ).withColumn("size", F.length("head") + F.length("body") + F.lit(len(END) + 1))
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("begin", begin).select(
        "tree", "branch", "score", "leaf",
        F.struct(
            "place", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "learn",
            F.struct(F.col("begin").cast("int").alias("start"), (F.col("begin") + F.length("body")).cast("int").alias("end")).alias("span"),
        ).alias("turn"),
    )
    whole = placed.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("branch").alias("branch"), F.first("score").alias("score"),
        F.array_sort(F.collect_list("turn")).alias("turns"),
    )
    return whole.select(
        "tree", "branch", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"),
    )


def as_chains(conversations: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of conversations as trees of one branch: each turn answers the one before.

    Turns that tie are ordered by role and text, nulls first; repeated rows are turns of their own.
    """
    order = Window.partitionBy(key).orderBy(turn, "role", "text")
    place = F.row_number().over(order)
    return conversations.select(
        F.col(key).alias("tree_id"), place.alias("message_id"),
        F.nullif(place - F.lit(1), F.lit(0)).alias("parent_id"), "role", "text",
    )
