"""Reply trees: root-to-leaf paths by iterative self-joins, ranked branches, formatted chats.

Column expressions and joins only. The template is ChatML-like; a control string inside a text
is broken by one backslash after its ``<`` and restored by taking one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.llm.common import staged

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """No ``<|`` is left: one more backslash between every ``<`` and ``|`` that only backslashes part."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line, without bars."""
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def unescaped_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def reply_paths(messages: DataFrame) -> DataFrame:
    """``(leaf, id, depth)`` for every message on the way from a root to each leaf, root 0.

    ``messages`` has unique ``id`` and ``parent`` (null, or an id that is missing, at a root).
    Jumps of 1, 2, 4, … replies are built by joining the jumps with themselves until none is
    left; each leaf then climbs by the largest jumps first, so that paths of n messages take
    about 2 log n joins and no row holds more than one message. Messages on a cycle, and those
    that answer to one, have no root and give no path: they alone still have an ancestor when
    the jump is longer than all messages together.
    """
    known = messages.select(F.col("id").alias("parent"))
    jump = staged(messages.select("id", "parent").join(known, "parent", "left_semi").select("id", F.col("parent").alias("up")))
    jumps: list[DataFrame] = []
    rounds = messages.count().bit_length()
    while (some := bool(jump.limit(1).count())) and len(jumps) < rounds:
        jumps.append(jump)
        further = jump.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jump = staged(jump.join(further, "up").select("id", F.col("next").alias("up")))
    leaves = messages.select("id").join(jumps[0].select(F.col("up").alias("id")), "id", "left_anti") if jumps else messages.select("id")
    if some:
        leaves = leaves.join(jump.select("id"), "id", "left_anti")
    paths = staged(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).alias("height")))
    for k in reversed(range(len(jumps))):
        above = paths.join(jumps[k], "id").select("leaf", F.col("up").alias("id"), (F.col("height") + (1 << k)).alias("height"))
        paths = staged(paths.union(above))  # read twice in the next round: a plan that doubles each time if kept lazy
    top = paths.groupBy("leaf").agg(F.max("height").alias("top"))
    return staged(paths.join(top, "leaf").select("leaf", "id", (F.col("top") - F.col("height")).alias("depth")))


def best_branches(paths: DataFrame, messages: DataFrame, branches: int = 1) -> DataFrame:
    """The paths of the ``branches`` best leaves of each tree, joined with their messages.

    A branch scores the mean ``score`` of its messages (null: 0); equal branches go by the
    longer path, then by the least leaf id. ``rank`` is 1 for the best.
    """
    full = paths.join(messages, "id")
    root = F.min(F.when(F.col("depth") == 0, F.col("id")))
    scored = full.groupBy("leaf").agg(root.alias("root"), F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"), F.count("*").alias("n"))
    order = Window.partitionBy("root").orderBy(F.desc("branch_score"), F.desc("n"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    return full.join(chosen.select("leaf", "root", "rank", "branch_score"), "leaf")


def formatted(turns: DataFrame, keys: list[str], order: str = "depth") -> DataFrame:
    """One row for each ``keys``: ``formatted`` and ``loss``, the spans (from, to: code points,
    end exclusive) of the formatted text that a loss is taken on: what the assistant says."""
    head = F.concat(F.lit(START), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    said = escaped(F.coalesce("text", F.lit("")))
    piece = turns.select(*keys, F.col(order).alias("place"), head.alias("head"), said.alias("said"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
    piece = piece.withColumn("long", F.length("head") + F.length("said") + len(END) + 1)
    before = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("at", F.coalesce(F.sum("long").over(before), F.lit(0)) + F.length("head"))
    rows = piece.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "head", "said", "learn", "at"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["said"], F.lit(END), F.lit("\n"))), "")
    spans = F.transform(F.filter("rows", lambda r: r["learn"]), lambda r: F.struct(r["at"].alias("from"), (r["at"] + F.length(r["said"])).alias("to")))
    return rows.select(*keys, text.alias("formatted"), spans.alias("loss"))


def read_back(chats: DataFrame, keys: list[str]) -> DataFrame:
    """What a trainer reads out of the formatted text alone: turns, and the text under the mask."""
    raw = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    turn = lambda p: F.struct(
        unescaped_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescaped(F.substring(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2, F.length(p))).alias("text"),
    )
    lossy = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    return chats.select(*keys, F.transform(raw, turn).alias("turns"), F.array_join(lossy, "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def messages_of(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: a turn answers the one before it.

    Rows go by turn (null first), equal turns by role and text, so repeated rows stay apart and
    follow each other. A null ``conv_id`` is a conversation of its own; null texts and roles are
    empty. No score is given: a linear tree has one branch.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("~")), n)
    parent = F.when(F.col("place") > 1, name(F.col("place") - 1))
    return placed.select(name(F.col("place")).alias("id"), parent.alias("parent"), "conv_id", "role", "text", F.lit(None).cast("double").alias("score"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Format every conversation and report what reads back, one row for each ``conv_id``."""
    messages = staged(messages_of(conversations))
    best = best_branches(reply_paths(messages), messages)
    chats = formatted(best, ["conv_id"])
    back = read_back(chats, ["conv_id"])
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
