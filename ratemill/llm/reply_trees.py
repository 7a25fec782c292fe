"""Conversations out of trees of replies, with DataFrame functions only.

Every message but a root answers another one of its tree. Self-joins that double their reach give each message its
depth and the score of the branch above it (steps grow with the logarithm of the deepest branch); leaves are ranked
within their tree by the score of their branch; joins with the same steps, the widest first, lay out the messages of the
chosen branches, and each branch becomes one formatted conversation. Only ids and scores take part in these steps; texts
are shuffled by message, then by branch, so a tree may hold any part of all rows.

Template: `<|turn|>`, the role (URL-encoded), a line feed, the text, `<|end|>` and a line feed for each turn. Control
strings inside a text, of this template and of others in use, get a backslash behind their first character; where
some stand already, one more. `unescaped` takes it out again. The loss falls on the text of assistant turns, all of it
and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.llm.tables import written
from ratemill.plans.skew import total_before_in_large_group

TURN, END = "<|turn|>", "<|end|>\n"
#: What follows the first character of a control string.
_TAIL = r"(\|\w+\|>|/?s>|</?SYS>>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def _key(column: str) -> Column:
    """A string that is never null and differs wherever the values differ."""
    return F.to_json(F.struct(F.col(column).alias("k")))


def _links(messages: DataFrame) -> DataFrame:
    """(tree, message, up, score): one row per message; `up` is null on roots."""
    one = messages.groupBy(_key("tree").alias("tree"), _key("message").alias("message")).agg(
        F.min("parent").alias("parent"),
        F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"),
    )
    one = one.withColumn("parent", F.when(F.col("parent").isNotNull(), F.to_json(F.struct(F.col("parent").alias("k")))))
    there = one.select(F.col("tree"), F.col("message").alias("parent"), F.col("message").alias("up"))
    return one.join(there, ["tree", "parent"], "left").select("tree", "message", "up", "score")


def _climbed(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, message, up, depth, total) of the messages that reach 2^k messages up, for each step k; and one of all
    messages that reach a root, with their depth and total from there on.

    `depth` and `total` cover the messages from this one up to `up`, which is not included. Only messages without a root yet
    take part in a step. Steps end when there are none, or as many as before: those stand on or below a circle.
    """
    table = written(links.select("tree", "message", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    steps, rooted = [], table.where("up IS NULL")
    before, left = -1, table.where("up IS NOT NULL").count()
    while left not in (0, before):
        climbing = table.where("up IS NOT NULL")
        steps.append(climbing)
        above = climbing.unionAll(rooted).select("tree", F.col("message").alias("up"), F.struct(F.col("up").alias("up"), "depth", "total").alias("more"))
        further = climbing.join(above, ["tree", "up"]).select(
            "tree",
            "message",
            F.col("more.up").alias("up"),
            (F.col("depth") + F.col("more.depth")).alias("depth"),
            (F.col("total") + F.col("more.total")).alias("total"),
        )
        table = written(further)
        rooted = rooted.unionAll(table.where("up IS NULL"))
        before, left = left, table.where("up IS NOT NULL").count()
    return steps, rooted


def reply_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, message, position): every message of every chosen branch.

    `messages` has tree, message, parent and score (sum along the branch; null counts as 0). Ids come back as keys, the
    JSON text of a struct of the id. `rank` counts a tree's branches from 1 by falling score, ties by the key of the leaf;
    `keep` chooses the best ones of each tree, by default all. `position` counts from the root, from 0.

    A null parent, or one that is not in the tree, makes a root. A null tree is a tree, a null message a root without answers. Rows that share tree
    and message are one message: its parent is the smallest, its score the largest. Messages on or below a circle of
    answers have no root and stand on no branch. Other columns are left aside.
    """
    steps, rooted = _climbed(_links(messages))
    leaves = rooted
    if steps:
        leaves = rooted.join(steps[0].select("tree", F.col("up").alias("message")).distinct(), ["tree", "message"], "left_anti")
    leaves = leaves.select("tree", F.col("message").alias("leaf"), "depth", "total", F.struct((-F.col("total")).alias("a"), F.col("message").alias("b")).alias("by"), F.lit(1).cast("long").alias("one"))
    ranked = total_before_in_large_group(leaves, "tree", "by", "one", "rank").withColumn("rank", F.col("rank") + 1)
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    paths = ranked.select("tree", "leaf", "rank", F.col("total").alias("path_score"), F.col("leaf").alias("message"), (F.col("depth") - 1).alias("position"))
    for k in reversed(range(len(steps))):
        ups = steps[k].select("tree", "message", "up")
        stay = F.struct(F.col("message").alias("message"), F.col("position").alias("position"))
        climb = F.struct(F.col("up").alias("message"), (F.col("position") - F.lit(1 << k)).alias("position"))
        both = F.explode(F.when(F.col("up").isNull(), F.array(stay)).otherwise(F.array(stay, climb))).alias("at")
        paths = paths.join(ups, ["tree", "message"], "left").select("tree", "leaf", "rank", "path_score", both)
        paths = paths.select("tree", "leaf", "rank", "path_score", "at.message", "at.position")
    return paths


def conversations(messages: DataFrame, links: DataFrame | None = None, keep: int | None = None, learned_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, path_score, n_turns, formatted, loss): one formatted conversation per chosen branch.

    `messages` has tree, message, role and text; parent and score too, unless `links` has them with tree and message; see `reply_paths`. `loss` lists the spans of code points
    of `formatted` that are learned: start, and end behind the last one, one span per turn of `learned_role`.

    Null roles and texts are empty. Rows that share tree and message are turns of their own, by role, then text; equal
    rows are as many turns. An empty table gives no rows.
    """
    paths = reply_paths(messages if links is None else links, keep)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    spoken = messages.select(_key("tree").alias("tree"), _key("message").alias("message"), role, text)
    turns = spoken.join(paths, ["tree", "message"])
    turns = turns.withColumn("_head", F.concat(F.lit(TURN), F.url_encode("role"), F.lit("\n"))).withColumn("_text", escaped(F.col("text")))
    by = Window.partitionBy("tree", "leaf").orderBy("position", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("_head") + F.length("_text") + F.lit(len(END))).over(by), F.lit(0))
    start = F.col("_at") + F.length("_head")
    span = F.when(F.col("role") == learned_role, F.struct(start.alias("start"), (start + F.length("_text")).alias("end")))
    turns = turns.withColumn("_at", before).withColumn("_order", F.row_number().over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    turns = turns.select("tree", "leaf", "rank", "path_score", F.struct("_order", F.concat("_head", "_text", F.lit(END)).alias("piece"), span.alias("span")).alias("turn"))
    whole = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select(
        "tree",
        "leaf",
        "rank",
        "path_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda p: F.url_decode(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), "\n", 1))
    text = lambda p: unescaped(F.regexp_replace(p, r"\A[^\n]*\n", ""))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def read_learned(formatted: Column, learned_role: str = "assistant") -> Column:
    """All text under the loss mask in order, nothing between: what stands in turns of `learned_role`, found in one pass."""
    found = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|turn\|>" + learned_role + r"\n(.*?)<\|end\|>\n"), F.lit(1))
    return F.array_join(F.transform(found, unescaped), "")
