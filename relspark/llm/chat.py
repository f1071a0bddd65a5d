"""Reply trees formatted as chat training text. Only DataFrame functions; no Python on the executors.

``reply_paths`` enumerates root-to-leaf paths by iterative self-joins that double their reach: after round i every leaf
knows its ancestors up to distance 2**(i + 1) - 1 and every node its ancestor at 2**(i + 1), so a chain of n replies takes
log2(n) rounds. The rows number as the nodes on the chosen output paths; nothing is paired within a tree. Branches are
ranked by the mean score of their nodes; ``format_paths`` writes each chosen path as one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for a turn. Inside roles and texts a backslash becomes ``\\s``, ``<``
becomes ``\\l``, ``[`` becomes ``\\b`` (and in roles a line feed ``\\n``), so no control string of this or of the common bracketed
templates can occur in them; ``read_back`` undoes it. The loss mask is a list of spans (offsets in code points) of the
escaped assistant texts.

Defined cases: null roles and texts are empty; a null conversation id is a conversation of its own, other than one named "null"; a parent that is null, missing
or not smaller than the node itself makes the node a root, so there are no cycles; of rows with the same node id the first
by role and text stays; rows with a null node id take no part; rows with equal turns follow each other in order of role and text; repeated turns all stay; an
empty table gives an empty result; other columns are ignored. A conversation is one output row, so it must fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relspark.llm.common import checkpoint

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column, header: bool = False) -> Column:
    for a, b in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), *((("\n", "\\n"),) if header else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, header: bool = False) -> Column:
    for a, b in (*((("\n", "\\n"),) if header else ()), ("[", "\\b"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def from_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as reply trees in which each turn answers the one before: conv, node, parent, score (the text's characters, for want of another), role, text."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", n.cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")


def _key(conv: Column) -> Column:
    """Of conversations; the null one differs from any text."""
    return F.when(conv.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), conv.cast("string")))


def reply_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """``nodes``: conv, node, parent, score, role, text. One row per node of each chosen path.

    Returns conv, leaf, branch (rank in its conversation by mean score, then leaf; from 1), depth (0 at the root), node, role, text.
    ``branches``: how many paths of a conversation to choose; None for all.
    """
    first = F.struct("role", "text", "parent", "score", "conv")
    nodes = nodes.filter("node is not null").withColumn("_k", _key(F.col("conv"))).withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    nodes = checkpoint(nodes.groupBy("_k", "node").agg(F.min(first).alias("_v")).select("_k", "node", "_v.*"))
    ids = nodes.select("_k", "node", F.when(F.col("parent") < F.col("node"), F.col("parent")).alias("up"))
    known = ids.select("_k", F.col("node").alias("up"))
    up = checkpoint(ids.filter("up is not null").join(known, ["_k", "up"], "left_semi").select("_k", "node", "up"))
    parents = up.select("_k", F.col("up").alias("node"))
    paths = checkpoint(ids.join(parents, ["_k", "node"], "left_anti").select("_k", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")))
    reach = 1
    while not up.isEmpty():
        more = paths.join(up, ["_k", "node"]).select("_k", "leaf", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist"))
        paths = checkpoint(paths.unionByName(more))
        above = up.select("_k", F.col("node").alias("up"), F.col("up").alias("_up2"))
        up = checkpoint(up.join(above, ["_k", "up"]).select("_k", "node", F.col("_up2").alias("up")))
        reach *= 2
    scored = paths.join(nodes.select("_k", "node", "score"), ["_k", "node"]) if branches is not None else None
    joined = paths
    if scored is not None:
        leaves = scored.groupBy("_k", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("_s"))
        rank = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("_s"), "leaf"))
        joined = paths.join(leaves.select("_k", "leaf", rank.alias("branch")).filter(F.col("branch") <= branches), ["_k", "leaf"])
    joined = joined.join(nodes.select("_k", "node", "conv", "role", "text", "score"), ["_k", "node"])
    joined = joined.withColumn("depth", F.max("dist").over(Window.partitionBy("_k", "leaf")) - F.col("dist"))
    return joined.select("_k", "conv", "leaf", *(["branch"] if branches is not None else []), "depth", "node", "role", "text", "score")


def format_paths(paths: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per path: conv, leaf, score (mean), n_turns, formatted, loss_spans (array of start, end: code points)."""
    head = F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"))
    body = escape(F.col("text"))
    rows = paths.withColumns({"_head": head, "_body": body}).withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    w = Window.partitionBy("_k", "leaf").orderBy("depth")
    start = F.sum(F.length("_piece").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_piece") + F.length("_head")
    rows = rows.withColumn("_start", start)
    span = F.struct(F.col("_start").alias("start"), (F.col("_start") + F.length("_body")).alias("end"))
    by = rows.groupBy("_k", "leaf").agg(
        F.first("conv").alias("conv"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("depth", "_piece"))).alias("_pieces"),
        F.sort_array(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("loss_spans"),
    )
    return by.select("conv", "leaf", "score", "n_turns", F.array_join("_pieces._piece", "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array of (role, text)."""
    segments = F.filter(F.split(formatted, F.lit(r"<\|im_start\|>")), lambda s: s != "")
    return F.transform(segments, lambda s: F.struct(unescape(F.substring_index(s, "\n", 1), True).alias("role"), unescape(F.substring_index(F.substr(s, F.length(F.substring_index(s, "\n", 1)) + 2), END, 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
