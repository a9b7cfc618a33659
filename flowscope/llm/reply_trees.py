"""Conversations from reply trees.

Messages point to the message they reply to. Iterative self-joins enumerate the paths from
root to leaf: in round k every message joins to the message 2^k steps above it, so a path of
n messages takes log2(n) joins, and depth and path score add up on the way. The leaves of a
tree are ranked by the mean score of their paths; going back through the same pointers, from
the longest to the shortest, marks the messages of every chosen path. Each chosen path is
formatted as one text.

A turn is ``<turn role>``, a line feed, the text, ``</turn>`` and a line feed. Inside roles
and texts ``&``, ``<`` and ``>`` are written as ``&amp;``, ``&lt;`` and ``&gt;``, so no text
can end or begin a turn, and reading back gives every string as it was.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.sizing import stored

LOSS_ROLE = "assistant"
END = "</turn>\n"


def escape(text: Column | str) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def turns_as_replies(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages of flat conversations: each turn replies to the one before it.

    Order is that of ``turn`` (nulls first), then of role and text; equal rows are separate
    messages. A score is the length of the text. Trees come as a struct of their id, which is
    not null even where the id is, so rows with a null id are one conversation.
    """
    kept = rows.select(
        F.struct(F.col(tree).alias("id")).alias("tree"), F.col(turn).alias("at"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    node = F.row_number().over(W.partitionBy("tree").orderBy("at", "role", "text")).cast("long")
    numbered = kept.withColumn("node", node)
    return numbered.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.length("text").cast("double").alias("score"))


def _lifted(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For k = 0, 1, ...: nodes with the node 2^k above each, and the depth and score sum of
    the 2^k nodes from it upwards (fewer at the root).

    Trees in which no node has any above leave after that round, so later rounds hold only
    the deep ones. The second result has the nodes that reached a root, with their depth and
    sum. Nodes on a cycle never do.
    """
    rounds, done = [stored(nodes)], None
    most = max(1, math.ceil(math.log2(max(2, rounds[0].count()))))
    for k in range(most + 2):
        last = rounds[-1]
        going = last.filter(F.col("up").isNotNull()).select("tree").distinct()
        over = last.join(going, "tree", "left_anti") if k <= most else last.filter(F.col("up").isNull())
        done = over if done is None else done.unionByName(over)
        if k > most or going.isEmpty():
            break
        deep = last.join(going, "tree", "left_semi")
        above = deep.select(
            "tree", F.col("node").alias("up"), F.col("up").alias("next"),
            F.col("depth").alias("more"), F.col("total").alias("rest"))
        rounds.append(stored(deep.join(above, ["tree", "up"], "left").select(
            "tree", "node", F.col("next").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("rest", F.lit(0.0))).alias("total"))))
    return rounds, done


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """Messages of the ``paths`` best root-to-leaf paths of every tree.

    ``messages``: ``tree``, ``node``, ``parent``, ``role``, ``text``, ``score``. Returns these
    with ``path`` (from 1, by falling mean score, ties to the smaller leaf) and ``depth``
    (from 1 at the root). A message whose parent is not in its tree, or null, is a root; a
    null score counts as 0. Of messages that repeat a node one is kept. Messages on a
    cycle are on no path from a root and are left out. Rows with a null tree or node are too.
    """
    known = messages.filter(F.col("tree").isNotNull() & F.col("node").isNotNull())
    row = F.struct("role", "text", F.coalesce("score", F.lit(0.0)).alias("score"), "parent")
    unique = known.groupBy("tree", "node").agg(F.min(row).alias("row")).select("tree", "node", "row.*")
    unique = stored(unique)
    names = unique.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = unique.join(names, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"),
        F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    rounds, whole = _lifted(linked)
    inner = rounds[0].select("tree", F.col("up").alias("node")).filter(F.col("node").isNotNull()).distinct()
    leaves = whole.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node"))
    marked = leaves.withColumn("path", rank).filter(F.col("path") <= paths).select("tree", "path", "node")
    for lift in reversed(rounds):  # each pass marks what is 2^k above anything marked so far
        up = lift.select("tree", "node", "up").filter(F.col("up").isNotNull())
        above = marked.join(up, ["tree", "node"]).select("tree", "path", F.col("up").alias("node"))
        marked = stored(marked.unionByName(above).distinct())  # read twice in the next pass
    depth = whole.select("tree", "node", "depth")
    return marked.join(depth, ["tree", "node"]).join(unique, ["tree", "node"]).select(
        "tree", "path", "depth", "node", "parent", "role", "text", "score")


def format_paths(paths: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One text per tree and path: ``tree``, ``path``, ``formatted`` and ``loss_spans``.

    Spans are ranges ``[begin, end)`` of code points of ``formatted`` that hold the escaped
    texts of ``loss_role``. One conversation is one value, so it has to fit in a task.
    """
    role, text = escape("role"), escape("text")
    head = F.concat(F.lit("<turn "), role, F.lit(">\n"))
    begin = F.sum(F.length("head") + F.length("body") + F.lit(len(END))).over(
        W.partitionBy("tree", "path").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    at = (F.coalesce(begin, F.lit(0)) + F.length("head")).cast("long")
    parts = paths.withColumns({"head": head, "body": text}).withColumn("at", at).select(
        "tree", "path", "depth", F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("role") == loss_role, F.struct(
            F.col("at").alias("begin"), (F.col("at") + F.length("body")).alias("end"))).alias("span"))
    lists = parts.groupBy("tree", "path").agg(
        F.array_sort(F.collect_list(F.struct("depth", "piece", "span"))).alias("turns"))
    return lists.select(
        "tree", "path", F.array_join("turns.piece", "").alias("formatted"),
        F.array_compact("turns.span").alias("loss_spans"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        head, _, body = piece.partition(">\n")
        turns.append((unescape(head[len("<turn "):]), unescape(body)))
    return turns


def conversations(
    rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``tree``, ``formatted`` and ``loss_spans`` of flat conversations, in order of turns.

    Null roles and texts count as empty; rows with a null ``tree`` are one conversation; an
    empty table gives no rows.
    """
    messages = turns_as_replies(rows, tree, turn, role, text)
    return format_paths(best_paths(messages)).select(F.col("tree.id").alias(tree), "formatted", "loss_spans")


def _digests(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, ranges in zip(formatted, spans):
        turns = read_back(text)
        loss = "".join(unescape(text[r["begin"]:r["end"]]) for r in ranges)
        rows.append((len(turns), "".join(f"{role}\n{body}\n" for role, body in turns), loss))
    return pd.DataFrame(rows, columns=["n_turns", "turns", "loss"])


def read_turns(formatted: Column | str, spans: Column | str) -> Column:
    """``n_turns``, ``turns`` and ``loss``: what the output says, read back from it."""
    return F.pandas_udf(_digests, "n_turns long, turns string, loss string")(formatted, spans)
