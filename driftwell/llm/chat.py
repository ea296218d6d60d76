"""Chat formatting from reply trees, with DataFrame functions only.

A message table has one row per message: tree, node, parent, role, text, score.  A root has no parent
among the tree's nodes, a leaf no child.  Branches (root-to-leaf paths) are ranked by the sum of
their scores, ties to the smaller leaf, and each chosen path becomes one conversation.

Paths are found by iterative self-joins that double in length: the table of 2**k-step ancestors is joined
with itself, so a tree of depth n takes log2(n) rounds.  A chosen leaf gathers its ancestors from
the same tables, each ancestor once.

Template, per turn: '### ' role ':' newline, text, newline '</turn>' newline.  In roles and texts a
backslash is doubled and each of the strings '### ' and '</turn>' gets a backslash in front, so
the formatted text reads back exactly.

Rows: null text and null role are empty.  A null tree forms one tree.  Repeated nodes of a tree:
one of them stays (smallest role, then text).  Messages on a cycle of parents have no root and hence
no path.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

END = "\n</turn>\n"
HEAD = r"(?s)^### ((?:[^:\\]++|\\.)*+):\n"
CONTROLS = ("</turn>", "### ")


def escape(c):
    """The text with its control strings marked, reversibly."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROLS:
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def unescape(c):
    """The inverse of escape()."""
    return F.regexp_replace(c, r"\\(\\|</turn>|### )", "$1")


def escape_role(c):
    """As escape(); colons too, as a colon ends the role."""
    return F.replace(escape(c), F.lit(":"), F.lit("\\:"))


def unescape_role(c):
    """The inverse of escape_role()."""
    return F.regexp_replace(c, r"\\(\\|</turn>|### |:)", "$1")


def ancestor_tables(messages: DataFrame, depth: int) -> list[DataFrame]:
    """[(tree, node, up, gain)]: k-th table: each node's 2**k-th ancestor (null if none) and the score of the nodes passed."""
    one = messages.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain"))
    tables = [one]
    for _ in range(max(0, math.ceil(math.log2(max(depth, 1))))):
        now = tables[-1]
        far = now.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("gain").alias("g2"))
        # nodes whose ancestors have run out are carried on without a join
        further = now.where("up is not null").join(far, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")))
        further = further.select("tree", "node", F.col("up2").alias("up"), (F.col("gain") + F.col("g2")).alias("gain"))
        tables.append(stash(further.unionByName(now.where("up is null"))))
    return tables


def clean_messages(messages: DataFrame) -> DataFrame:
    """Columns tree, node, parent, role, text, score without nulls in the last three; absent parents become null."""
    m = (
        messages.select(
            "tree",
            F.col("node").cast("long").alias("node"),
            F.col("parent").cast("long").alias("parent"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        )
        .where("node is not null")
        .groupBy("tree", "node")
        .agg(F.min(F.struct("role", "text", "parent", "score")).alias("s"))
        .select("tree", "node", "s.parent", "s.role", "s.text", "s.score")
    )
    have = m.select(F.col("tree").alias("t1"), F.col("node").alias("n1"))
    return m.join(have, F.col("tree").eqNullSafe(F.col("t1")) & (F.col("parent") == F.col("n1")), "left").select(
        "tree", "node", F.col("n1").alias("parent"), "role", "text", "score"
    )


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, branch, leaf, node, height, role, text): the nodes of the `top` best branches; height counts up from the leaf."""
    m = stash(clean_messages(messages))
    depth = m.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    tables = ancestor_tables(m.select("tree", "node", "parent", "score"), depth)
    inner = m.where("parent is not null").select(F.col("tree").alias("t3"), F.col("parent").alias("p3")).distinct()
    leaves = tables[-1].where("up is null").join(
        inner, F.col("tree").eqNullSafe(F.col("t3")) & (F.col("node") == F.col("p3")), "left_anti"
    )
    rank = Window.partitionBy("tree").orderBy(F.desc("gain"), "node")
    path = stash(
        leaves.withColumn("branch", F.row_number().over(rank))
        .where(F.col("branch") <= top)
        .select("tree", "branch", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    )
    for k in range(len(tables) - 1, -1, -1):
        up = tables[k].where("up is not null").select(F.col("tree").alias("t4"), F.col("node").alias("n4"), "up")
        above = path.join(up, F.col("tree").eqNullSafe(F.col("t4")) & (F.col("node") == F.col("n4"))).select(
            "tree", "branch", "leaf", F.col("up").alias("node"), (F.col("height") + (1 << k)).alias("height")
        )
        path = stash(path.unionByName(above))
    text = m.select(F.col("tree").alias("t5"), F.col("node").alias("n5"), "role", "text")
    return path.join(text, F.col("tree").eqNullSafe(F.col("t5")) & (F.col("node") == F.col("n5"))).drop("t5", "n5")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, branch, formatted, loss): the formatted conversation and its loss spans (start, length in code points)."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("at"), "role", "text"))), lambda x: F.struct(
        F.concat(F.lit("### "), escape_role(x["role"]), F.lit(":\n")).alias("head"),
        escape(x["text"]).alias("body"),
        (x["role"] == loss_role).alias("counts"),
    ))
    put = lambda s, t: F.struct(
        (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
        F.when(t["counts"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
    )
    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>))")
    return (
        paths.groupBy("tree", "branch")
        .agg(turns.alias("turns"))
        .select(
            "tree",
            "branch",
            F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
            F.aggregate("turns", start, put, lambda s: s["spans"]).alias("loss"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The formatted rows with turns (role, text), and the unescaped text under the loss mask, read from the output alone."""
    parts = F.filter(F.split("formatted", END), lambda x: x != "")
    return formatted.select(
        "*",
        F.transform(parts, lambda x: F.struct(
            unescape_role(F.regexp_extract(x, HEAD, 1)).alias("role"),
            unescape(F.regexp_replace(x, HEAD, "")).alias("text"),
        )).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "").alias("loss_text"),
    )


def linear_threads(conversations: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text): each turn replies to the one before; ties by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("node")).select(
        F.col("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )


def digests(back: DataFrame) -> DataFrame:
    """One row per conversation with the digests of what was read back."""
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
