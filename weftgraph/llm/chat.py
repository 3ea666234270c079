"""Chat formatting: reply trees to formatted conversations, in DataFrame operations only.

``reply_paths`` finds the root of every message and its place on the way there
by self-joins that double the reach each time, on ids alone; ranks the leaves of
each conversation by the score of their branch; and lists the messages of the
chosen paths. ``format_paths`` joins the texts and renders each path once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpoint, shuffles_dropped

START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No control string is left: a backslash goes between ``<`` and ``|``, also where some already are."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and a role stays on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """Messages (conv, msg, parent, score) to the chosen paths (conv, path_rank, leaf, step, msg).

    A message whose parent is null or absent from its conversation is a root. A
    branch's score is the sum over its messages, null scores counting 0;
    branches rank by score, ties by leaf id, and the first ``best`` of each
    conversation are chosen. Ids of one conversation must differ; messages on a
    cycle of parents have no root and are on no path.
    """
    scratch = Scratch(messages.sparkSession, "reply-paths")
    has = messages.select("conv", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    nodes = messages.alias("m").join(has.alias("p"), F.col("m.conv").eqNullSafe(F.col("p.conv")) & (F.col("m.parent") == F.col("p.parent")), "left")
    nodes = nodes.select("m.conv", "m.msg", F.when(F.col("p.there"), F.col("m.parent")).alias("up"), F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score"), F.lit(1).cast("long").alias("depth"))
    inner = nodes.filter("up IS NOT NULL").select("conv", F.col("up").alias("msg"), F.lit(True).alias("inner")).distinct()
    at = lambda a, b, on: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{on}") == F.col(f"{b}.msg"))
    nodes = nodes.alias("n").join(inner.alias("i"), at("n", "i", "msg"), "left").select("n.*", F.col("i.inner").isNull().alias("leaf"))

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Who has reached the root, who has not; written once each."""
        table = scratch.write(rows.withColumn("done", F.col("up").isNull()), "done")
        return table.filter("done").drop("done"), table.filter("NOT done").drop("done")

    done, hop = split(nodes)
    hops: list[DataFrame] = []  # the k-th: messages and the one 2**k above
    count = done.count() + (left := hop.count())
    while left and 1 << len(hops) <= count:
        hops.append(hop)
        over = done.unionByName(hop).select("conv", "msg", "up", "score", "depth")
        further = hop.alias("n").join(over.alias("o"), at("n", "o", "up")).select(
            "n.conv", "n.msg", F.col("o.up").alias("up"), (F.col("n.score") + F.col("o.score")).alias("score"), (F.col("n.depth") + F.col("o.depth")).alias("depth"), "n.leaf"
        )
        more, hop = split(further)
        done, left = done.unionByName(more), hop.count()
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("score").desc(), "msg"))
    chosen = done.filter("leaf").withColumn("path_rank", rank).filter(F.col("path_rank") <= best)
    # walk up from the chosen leaves: the stretch of 1, 2, 4... messages above each found one is found in turn
    paths = chosen.select("conv", "path_rank", F.col("msg").alias("leaf"), "msg", F.col("depth").alias("step"))
    for k in reversed(range(len(hops))):
        paths = scratch.write(paths)  # else the plan would double with each hop
        more = paths.alias("p").join(hops[k].alias("h"), at("p", "h", "msg"))
        more = more.select("p.conv", "p.path_rank", "p.leaf", F.col("h.up").alias("msg"), (F.col("p.step") - (1 << k)).alias("step"))
        paths = paths.unionByName(more)
    with shuffles_dropped(messages.sparkSession):
        paths = checkpoint(paths.select("conv", "path_rank", "leaf", "step", "msg"))
    scratch.drop()
    return paths


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """Each path as one formatted conversation.

    Output: conv, path_rank, formatted, and loss_spans: for each assistant
    turn, where its escaped text lies in ``formatted``, in code points, end
    excluded. Null roles and texts are empty.
    """
    turn = paths.alias("p").join(messages.alias("m"), F.col("p.conv").eqNullSafe(F.col("m.conv")) & (F.col("p.msg") == F.col("m.msg")))
    head = F.concat(F.lit(START), escape_role(F.coalesce("m.role", F.lit(""))), F.lit("\n"))
    turn = turn.select("p.conv", "p.path_rank", "p.step", head.alias("head"), escape(F.coalesce("m.text", F.lit(""))).alias("body"), (F.coalesce("m.role", F.lit("")) == "assistant").alias("loss"))
    turns = turn.groupBy("conv", "path_rank").agg(F.array_sort(F.collect_list(F.struct("step", "head", "body", "loss"))).alias("turns"))
    size = F.length(F.lit(STOP)) + 1
    place = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + size).alias("at"),
            F.when(t["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(STOP + "\n"))), "")
    return turns.select("conv", "path_rank", text.alias("formatted"), place.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), "\n", 1)).alias("role"),
        unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
    ))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chains(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each replies to the one before it by turn, ties by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("msg", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("conv"), "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text; other columns are not carried) as one formatted row each.

    Null ids form one conversation. Null turns come first. An empty table gives
    an empty result.
    """
    with shuffles_dropped(turns.sparkSession):
        messages = checkpoint(chains(turns))
    return format_paths(reply_paths(messages.select("conv", "msg", "parent", "score")), messages).withColumnRenamed("conv", "conv_id")
