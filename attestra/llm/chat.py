r"""Chat formatting of reply trees.

Messages form trees: tree_id, message_id, parent_id (null: a root), role, text,
score.  Self-joins double the ancestor links, so a tree of depth d takes about
log2(d) of them to give every message its depth and the score of its path.
Leaves end the branches; branches of a tree are ranked by that score and the
best are chosen.  The links then fill in each chosen path, again doubling, and
every path is formatted as one conversation.

The template is ``<|im_start|>role\ntext<|im_end|>\n``.  Inside texts a ``<``, any
backslashes and a ``|`` get one backslash more, so no control string can arise,
and one less gives the text back.  In roles, backslash and line feed are escaped.

Defined results: null text and null role are the empty text; a parent that does
not exist in the tree makes its message a root; messages on a cycle have no root
and are on no path; of repeated (tree_id, message_id) rows one is kept, the
smallest by role and text; rows without tree_id or message_id are left out; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def linear(turns: DataFrame) -> DataFrame:
    """Messages of conversations without branches: rows by turn, each a reply to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message_id"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return place.select(F.col("conv_id").alias("tree_id"), "message_id", parent.alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``format_trees`` of conversations without branches; rows without conv_id are one conversation, whose id is null."""
    kind = turns.schema["conv_id"].dataType
    told = turns.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv_id"), "turn", "role", "text")
    out = format_trees(linear(told))
    return out.withColumn("conv_id", F.nullif(F.substring("conv_id", 2, 1 << 30), F.lit("")).cast(kind))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree_id, leaf_id, branch_rank, depth, message_id: the messages of each tree's ``best`` branches."""
    nodes = messages.filter(F.col("tree_id").isNotNull() & F.col("message_id").isNotNull())
    nodes = nodes.groupBy("tree_id", "message_id").agg(F.min_by(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score")), F.struct("role", "text", "parent_id")).alias("m"))
    nodes = nodes.select("tree_id", "message_id", F.col("m.parent_id").alias("parent_id"), F.col("m.score").alias("score"))
    known = nodes.select("tree_id", F.col("message_id").alias("parent_id"), F.lit(True).alias("known"))
    nodes = nodes.join(known, ["tree_id", "parent_id"], "left")
    nodes = nodes.select("tree_id", "message_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    links = [keep(nodes, "chat-links-0")]
    rooted, going = links[0].filter("up IS NULL"), links[0].filter("up IS NOT NULL")
    # After round i a link leads 2**i messages up; depth and score cover what it passes.
    # Only messages whose links have not reached a root go on.
    largest = links[0].groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while len(links) <= largest.bit_length() and not going.isEmpty():  # only a cycle goes on for longer
        all_ = rooted.unionByName(going)
        above = all_.select("tree_id", F.col("message_id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        step = going.join(above, ["tree_id", "up"]).select("tree_id", "message_id", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth"))
        links.append(keep(step, f"chat-links-{len(links)}"))
        rooted, going = rooted.unionByName(links[-1].filter("up IS NULL")), links[-1].filter("up IS NOT NULL")
    inner = links[0].select("tree_id", F.col("up").alias("message_id")).filter("message_id IS NOT NULL")
    leaves = rooted.join(inner, ["tree_id", "message_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "message_id"))
    chosen = leaves.withColumn("branch_rank", rank).filter(F.col("branch_rank") <= best)
    path = chosen.select("tree_id", F.col("message_id").alias("leaf_id"), "branch_rank", "depth", "message_id")
    for i, link in enumerate(links[:-1]):
        hop = link.select("tree_id", "message_id", "up").filter("up IS NOT NULL")
        more = path.join(hop, ["tree_id", "message_id"]).select("tree_id", "leaf_id", "branch_rank", (F.col("depth") - 2**i).alias("depth"), F.col("up").alias("message_id"))
        path = keep(path.unionByName(more), f"chat-paths-{i}")  # else the plan would double too
    return path


def escape(text):
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """conv_id, branch_rank, formatted and loss: the [start, end) code points of assistant texts."""
    texts = messages.groupBy("tree_id", "message_id").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    turns = paths(messages, best).join(texts, ["tree_id", "message_id"])
    role = F.replace(F.replace("m.role", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    turns = turns.select("tree_id", "branch_rank", "depth", escape(role).alias("role"), escape(F.col("m.text")).alias("text"))
    whole = F.sort_array(F.collect_list(F.struct("depth", "role", "text")))
    turns = turns.groupBy("tree_id", "branch_rank").agg(whole.alias("turns"))
    wrapped = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.lit(len(OPEN) + 1 + len(CLOSE)) + F.length(t["role"]) + F.length(t["text"])).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.lit(len(OPEN) + 1) + F.length(t["role"])).alias("start"),
                    (acc["at"] + F.lit(len(OPEN) + 1) + F.length(t["role"]) + F.length(t["text"])).alias("end"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return turns.select(F.col("tree_id").alias("conv_id"), "branch_rank", F.array_join(wrapped, "").alias("formatted"), spans.alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the template alone."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
        turns.append((role, unescape(m[2])))
        at = m.end()
    return turns


def digest(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(text: pd.Series, loss: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, spans in zip(text, loss):
            turns = parse(whole)
            learnt = "".join(unescape(whole[s["start"] : s["end"]]) for s in spans)
            told = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", read("formatted", "loss").alias("r")).select("conv_id", "r.*")
