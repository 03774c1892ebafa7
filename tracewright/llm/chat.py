"""Chat formatting of reply trees, in DataFrame functions only.

Root-to-leaf paths come from self-joins that double the reach of every message's ancestor pointer, so a thread of n
replies takes log2(n) rounds. Leaves are ranked within their root by the score of their path; the chosen paths are then
unrolled with the same pointers, from the farthest to the nearest, and each becomes one conversation.

Template: <|im_start|>role, newline, text, <|im_end|>, newline. A control string starts with "<|"; in texts and roles
"<", backslashes and "|" get one backslash more, which is undone on reading, so no text can end its own turn. In roles
"%" and newlines are percent-encoded besides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _role_out(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reply_paths(messages: DataFrame, id_col: str = "msg_id", parent_col: str = "parent_id", score_col: str = "score", branches: int = 1) -> DataFrame:
    """(root, leaf, rank, node, depth): the messages of the best branches of each tree, depth 1 at the root.

    A branch's score is the sum of its messages' scores (null: 0); ties go to the longer branch, then to the smaller
    leaf id. A message without a parent, or whose parent isn't there, is a root. Messages without an id are left out,
    repeated ids count once (smallest parent and score), and messages on a cycle have no root and so no path. An empty
    table gives no path.
    """
    rows = messages.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score")).where("id is not null")
    rows = materialize(rows.groupBy("id").agg(F.min("parent").alias("parent"), F.min("score").alias("score")), "chat-nodes")
    there = rows.select(F.col("id").alias("parent")).withColumn("there", F.lit(True))
    state = rows.join(there, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("id").alias("top"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth"))
    parents = state.where("up is not null").select(F.col("up").alias("id")).distinct()
    # level j holds the messages whose 2**j-th ancestor is looked up; those that reached their root stay behind
    levels = [materialize(state, "chat-jump")]
    n, done = levels[0].count(), []
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        done.append(levels[-1].where("up is null"))
        last = levels[-1].where("up is not null")
        if last.isEmpty():
            break
        far = reduce(DataFrame.unionByName, [*done, last]).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("sum").alias("sum2"), F.col("depth").alias("depth2"))
        step = last.join(far, "up").select("id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("depth") + F.col("depth2")).alias("depth"))
        levels.append(materialize(step, "chat-jump"))
    placed = reduce(DataFrame.unionByName, done)
    best = Window.partitionBy("top").orderBy(F.desc("sum"), F.desc("depth"), F.asc("id"))
    chosen = placed.join(parents, "id", "left_anti").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    # a leaf enters at the level of its farthest jump, so short branches pass through few joins
    far_level = F.when(F.col("depth") > 1, F.floor(F.log2(F.col("depth") - 1))).otherwise(-1)
    chosen = materialize(chosen.select(F.col("top").alias("root"), F.col("id").alias("leaf"), "rank", F.col("id").alias("node"), far_level.alias("level")), "chat-leaves")
    path = chosen.where("level < 0").drop("level")
    longer = None
    for j in reversed(range(len(levels))):
        enter = chosen.where(F.col("level") == j).drop("level")
        longer = enter if longer is None else longer.unionByName(enter)
        jump = levels[j].where("up is not null").select(F.col("id").alias("node"), "up")
        longer = longer.join(jump, "node", "left").select("root", "leaf", "rank", F.explode(F.filter(F.array("node", "up"), lambda x: x.isNotNull())).alias("node"))
    path = path.unionByName(longer)
    return path.join(placed.select(F.col("id").alias("node"), "depth"), "node").select("root", "leaf", "rank", "node", "depth")


def format_paths(paths: DataFrame, messages: DataFrame, keys: list[str], id_col: str = "msg_id", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """keys, formatted, segments, loss_mask: one conversation per key. formatted is the segments joined; loss_mask marks those to learn from.

    Null roles and texts are empty. A conversation is one row, so one row must hold one path; nothing larger is gathered.
    """
    body = messages.select(F.col(id_col).alias("node"), F.coalesce(F.col(role_col), F.lit("")).alias("__role"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).dropDuplicates(["node"])
    turns = paths.join(body, "node").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("depth", F.col("__role").alias("role"), F.col("__text").alias("text")))).alias("t"))
    parts = F.flatten(F.transform("t", lambda x: F.array(F.concat(F.lit(START), _role_out(x["role"]), F.lit("\n")), escape(x["text"]), F.lit(END))))
    mask = F.flatten(F.transform("t", lambda x: F.array(F.lit(False), x["role"] == learn, F.lit(False))))
    return turns.select(*keys, parts.alias("segments"), mask.alias("loss_mask")).withColumn("formatted", F.array_join("segments", ""))


def read_turns(formatted: str | Column = "formatted") -> Column:
    """array<struct<role, text>> of a formatted conversation, parsed from the string alone."""
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.filter(F.split(c, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turn(p: Column) -> Column:
        whole = F.substring(p, F.lit(1), F.length(p) - len(END))
        role = F.substring_index(whole, "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescape(F.substring(whole, F.length(role) + 2, F.length(whole))).alias("text"))

    return F.transform(pieces, turn)


def loss_text() -> Column:
    """The text under the mask, in order, unescaped."""
    both = F.arrays_zip("segments", "loss_mask")
    return F.array_join(F.transform(F.filter(both, lambda x: x["loss_mask"]), lambda x: unescape(x["segments"])), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Format every conversation (rows by turn; equal turns by role and text) as a chain of replies, write it, and describe what was read back.

    Null conversation ids are one conversation. Empty table: no row.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    key = lambda n: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("~")), F.lit(":"), n.cast("string"))
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    messages = materialize(numbered.select("conv_id", "role", "text", key(F.col("n")).alias("msg_id"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent_id"), F.lit(1.0).alias("score")), "chat-messages")
    paths = reply_paths(messages)
    convs = messages.where("parent_id is null").select(F.col("msg_id").alias("root"), "conv_id")
    out = materialize(format_paths(paths, messages, ["root"]).join(convs, "root"), "chat")
    turns = F.array_join(F.transform(read_turns(), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    lines = out.select("conv_id", F.size(read_turns()).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss_text().alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return lines.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
