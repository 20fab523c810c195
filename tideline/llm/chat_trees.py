"""Reply trees to training conversations (operator 2), in DataFrame functions only.

Ancestors are found by doubling: after k self-joins each message knows its ancestor 2^k steps up, and each
leaf the last 2^k messages of its path. So a tree of depth d takes log2(d) rounds of joins over ids; roles
and texts join the chosen paths once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Text in which no control string stands: a backslash more after each ``<`` that leads to ``|``."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """The text before ``escaped``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def threads(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """A table of turns as reply trees of one branch: each turn answers the one before it. Equal turns are
    ordered by role and text; a null turn comes first."""
    own = common.own_columns(turns, conv=id_column, turn=turn_column, role=role_column, text=text_column)
    order = W.partitionBy("conv").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    return own.withColumn("node", F.row_number().over(order).cast("long")).select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """``tree, leaf, node, back`` for each message on each path from a leaf (back = 0) up to its root.

    A message whose parent is missing is a root. Messages that hang on a circle of parents have no root and
    no path.
    """
    nodes = common.stored(messages.select("tree", "node", "parent", "score"))
    above = nodes.select("tree", F.col("node").alias("parent"))
    jumps = common.stored(nodes.where("parent is not null").join(above.distinct(), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")))
    inner = jumps.select("tree", F.col("up").alias("node")).distinct()
    trail = nodes.select("tree", "node").distinct().join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    steps, longest = 1, nodes.count()
    rooted = jumps.select("tree", F.col("node").alias("top"))
    while steps <= longest and not jumps.isEmpty():
        further = trail.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + steps).alias("back"))
        trail = common.stored(trail.union(further))
        jumps = common.stored(jumps.join(jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("higher")), ["tree", "up"]).select("tree", "node", F.col("higher").alias("up")))
        steps *= 2
    roots = trail.join(rooted, (trail.tree == rooted.tree) & (trail.node == rooted.top), "left_anti").select("tree", "leaf").distinct()
    return trail.join(roots, ["tree", "leaf"], "left_semi")


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One conversation per chosen path: ``conv, leaf, rank, path_score, n_turns, formatted, segments,
    loss_spans``.

    ``messages``: conv, node, parent, role, text, score; nodes are unique in a conversation. Paths are ranked in
    each conversation by their mean score (null counts 0), then by leaf; ``branches`` of them stay, or
    all. ``segments`` are the pieces of ``formatted`` in order, each with whether the loss counts on it: the
    texts of assistants do. ``loss_spans`` are the same ranges in code points, end exclusive. Null roles
    and texts are empty. Messages with a null conversation form one. An empty table gives no row.
    """
    keyed = messages.select("conv", "node", "parent", "role", "text", "score").withColumn("tree", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("none")))
    found = paths(keyed)
    scored = found.join(keyed.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("path_score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    turns = found.join(ranked, ["tree", "leaf"]).join(keyed.select("tree", "node", "conv", "role", "text"), ["tree", "node"])
    turns = turns.select("tree", "leaf", "conv", "rank", "path_score", (-F.col("back")).alias("at"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss"), F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    long = F.char_length("head") + F.char_length("body") + len(END) + 1
    before = F.coalesce(F.sum(long).over(W.partitionBy("tree", "leaf").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.char_length("head")
    turns = turns.withColumn("from", before.cast("long")).withColumn("to", (F.col("from") + F.char_length("body")).cast("long"))
    whole = turns.groupBy("tree", "leaf").agg(F.first("conv").alias("conv"), F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct("at", "head", "body", "loss", "from", "to"))).alias("t"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda x: F.array(piece(x["head"], F.lit(False)), piece(x["body"], x["loss"]), piece(F.lit(END + "\n"), F.lit(False)))))
    return whole.select("conv", "leaf", "rank", "path_score", F.size("t").cast("long").alias("n_turns"), segments.alias("segments"), F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["from"].alias("start"), x["to"].alias("end"))).alias("loss_spans")).withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    body = lambda x: F.substring(x, F.instr(x, "\n") + 1, F.length(x))
    return F.transform(turns, lambda x: F.struct(_role_back(F.substring(F.substring_index(x, "\n", 1), F.lit(len(START) + 1), F.length(x))).alias("role"), unescaped(body(x)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")
