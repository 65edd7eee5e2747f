"""Conversations as training texts of bounded length. DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A window is a span with
what goes before it: the system turn, and as many of the last turns as the budget and ``history``
allow. Only new assistant turns are targets, so that each is learnt once.

A template marks the turns. Control strings inside texts, its own and those of other common
templates, are broken by a backslash, and backslashes are doubled, so :func:`unescape` gives the text back.

No task needs a whole conversation: turns are dealt by (conversation, block of turn numbers), prefix
sums of blocks are taken over blocks, and repeated turns meet their windows by a bucket of token places.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

# The marks of the template, and control strings of other templates.
BEGIN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (BEGIN, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Turn numbers that a block spans.
BLOCK_BITS = 10
#: Tokens of a turn's marks; no turn has fewer.
MARKS = 4
KEYS = ["none", "conv", "block"]


def escape(text: Column) -> Column:
    """``text`` without control strings: a backslash after the first character of each, all others doubled."""
    heads = {c[0] for c in CONTROLS}
    inside = "|".join(rf"{re.escape(h)}(?={'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == h)})" for h in sorted(heads))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), inside, r"$0\\")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def quarter(text: Column) -> Column:
    """An estimate of a text's tokens: one for each four code points begun."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def _spans(rows: DataFrame, blocks: DataFrame, budget: int) -> DataFrame:
    """Turns with k, the number of their span in the block, and g, the tokens before them."""
    order = Window.partitionBy(*KEYS).orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    r = rows.join(blocks.select(*KEYS, "offset", "first", F.coalesce("system.cost", F.lit(0).cast("long")).alias("kept")), KEYS)
    r = r.withColumn("nth", F.row_number().over(order))
    r = r.withColumn("lead", F.col("first") & (F.col("nth") == 1) & (F.col("role") == "system"))
    r = r.withColumns({"cost": F.when(F.col("lead"), F.lit(0).cast("long")).otherwise(F.col("cost")), "room": F.greatest(F.lit(budget) - F.col("kept"), F.lit(1))})
    half = F.greatest(F.expr("room div 2"), F.lit(1).cast("long"))
    r = r.withColumns({"at": F.coalesce(F.sum("cost").over(before), F.lit(0).cast("long")), "half": half})
    # turns that begin in one half of the room make at most the room together, if none is longer than that half
    r = r.withColumns({"long": F.col("cost") > F.col("half"), "bucket": F.expr("at div half")})
    was = lambda c: F.lag(c).over(order)
    cut = (F.col("nth") == 1) | (~was("lead") & (F.col("long") | was("long") | (F.col("bucket") != was("bucket"))))
    r = r.withColumn("cut", F.when(cut, 1).otherwise(0))
    r = r.withColumn("k", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = F.when(F.col("lead"), F.lit(-1).cast("long")).otherwise(F.col("offset") + F.col("at"))
    return r.select(*KEYS, "k", g.alias("g"), "role", "text", F.when(F.col("lead"), F.col("kept")).otherwise(F.col("cost")).alias("cost"), "room")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokens: Callable[[Column], Column] = quarter) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as texts of at most ``budget`` tokens.

    Columns: conv_id; start (tokens of the conversation before the first new turn, -1 if that is
    the system turn; orders a conversation's windows); tokens (marks included); n_repeated (turns at
    the head that other windows hold as new); text; turns (array of start, length, repeated, loss: the
    place of each turn's escaped text in ``text``, in code points, and whether it is learnt).

    A conversation's system turn is its first one, if its role is ``system``; each window has it.
    Up to ``history`` tokens of the turns before the new ones are repeated, fewer if the
    budget is short. New turns of the role ``assistant`` are learnt. ``tokens``
    counts those of a text column. Turns are never cut: one that is too long for the budget is the only
    new turn of a window that exceeds it.

    Turns are ordered by (turn, role, text). Null text or role: as empty. Null conv_id: all such rows
    are one conversation. Null turn: before others. Repeated rows: turns of their own. No rows: none.
    Further columns are ignored."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    zero = F.lit(0).cast("long")
    rows = turns.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), zero).alias("conv"), F.coalesce(F.shiftright(F.col("turn").cast("long"), BLOCK_BITS), F.lit(-(1 << 62)).cast("long")).alias("block"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (tokens(text) + MARKS).cast("long").alias("cost"))
    # one row a block: its tokens, those before it, and the conversation's system turn
    head = F.min_by(F.struct("role", "text", "cost"), F.struct("turn", "role", "text"))
    blocks = rows.groupBy(*KEYS).agg(F.sum("cost").alias("sum"), head.alias("head"))
    over = Window.partitionBy("none", "conv").orderBy("block")
    lead = F.first("head").over(over)
    blocks = blocks.withColumns({"first": F.row_number().over(over) == 1, "system": F.when(lead["role"] == "system", lead), "before": F.coalesce(F.sum("sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), zero)})
    offset = F.when(F.col("first") | F.col("system").isNull(), F.col("before")).otherwise(F.col("before") - F.col("system.cost"))
    blocks = materialize(blocks.select(*KEYS, "first", "system", offset.alias("offset")), "chat-blocks")
    spans = materialize(_spans(rows, blocks, budget), "chat-spans")

    each = spans.groupBy(*KEYS, "k").agg(F.min("g").alias("start"), F.sum(F.when(F.col("g") < 0, zero).otherwise(F.col("cost"))).alias("new"), F.min("room").alias("room"))
    keep = F.greatest(F.least(F.lit(history), F.col("room") - F.col("new")), zero)
    wanted = each.select(*KEYS, "k", "start", (F.col("start") - keep).alias("since")).filter("since < start and start > 0")
    near = max(1, history)
    wanted = wanted.withColumn("near", F.explode(F.sequence(F.expr(f"greatest(since, 0L) div {near}"), F.expr(f"(start - 1) div {near}"))))
    past = spans.filter("g >= 0").select("none", "conv", F.expr(f"g div {near}").alias("near"), "g", "role", "text", "cost")
    again = wanted.join(past, ["none", "conv", "near"]).filter("g >= since and g < start")
    system = each.filter("start >= 0").join(blocks.filter("system is not null").select(*KEYS, "system"), KEYS)
    members = spans.select(*KEYS, "k", "g", F.lit(False).alias("repeated"), "role", "text", "cost")
    members = members.unionByName(again.select(*KEYS, "k", "g", F.lit(True).alias("repeated"), "role", "text", "cost"))
    members = members.unionByName(system.select(*KEYS, "k", F.lit(-1).cast("long").alias("g"), F.lit(True).alias("repeated"), "system.role", "system.text", "system.cost"))
    loss = ~F.col("repeated") & (F.col("role") == "assistant")
    piece = F.struct("g", "repeated", loss.alias("loss"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), "cost")
    # g tells the turns of a window apart, as each but the system turn has tokens
    grouped = members.groupBy(*KEYS, "k").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("cost").alias("tokens"), F.min(F.when(~F.col("repeated"), F.col("g"))).alias("start"))
    lead_in, tail = F.length(F.lit(BEGIN)) + F.length(F.lit(SEP)), F.length(F.lit(END))
    place = lambda s, x: F.struct((s["at"] + lead_in + F.length(x["role"])).alias("start"), F.length(x["text"]).alias("length"), x["repeated"].alias("repeated"), x["loss"].alias("loss"))
    none = F.array().cast("array<struct<start:int,length:int,repeated:boolean,loss:boolean>>")
    step = lambda s, x: F.struct((s["at"] + lead_in + F.length(x["role"]) + F.length(x["text"]) + tail).alias("at"), F.concat(s["turns"], F.array(place(s, x))).alias("turns"))
    placed = F.aggregate("p", F.struct(F.lit(0).alias("at"), none.alias("turns")), step)["turns"]
    marked = F.array_join(F.transform("p", lambda x: F.concat(F.lit(BEGIN), x["role"], F.lit(SEP), x["text"], F.lit(END))), "")
    n = F.size(F.filter("p", lambda x: x["repeated"]))
    return grouped.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "start", "tokens", n.alias("n_repeated"), marked.alias("text"), placed.alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, start, new (array of role, text of the new turns), learnt (the texts under the loss
    mask in order), parsed and unescaped from the texts of :func:`windows`."""
    parts = F.split("text", re.escape(END), -1)
    parts = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    role = lambda p: F.substring_index(p, SEP, 1).substr(F.lit(len(BEGIN) + 1), F.length(p))
    new = F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring_index(p, SEP, -1)).alias("text")))
    learnt = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: unescape(F.col("text").substr(t["start"] + 1, t["length"])))
    return formatted.select("conv_id", "start", new.alias("new"), learnt.alias("learnt"), F.length("text").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation: number and hash of its turns, length and hash of what is learnt, code
    points formatted. A hash is over a conversation's whole text, so this is gathered in one row."""
    back = read_back(formatted)
    line = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", "start", F.size("new").cast("long").alias("n"), line.alias("said"), F.array_join("learnt", "").alias("learnt"), F.col("n_chars").cast("long").alias("n_chars"))
    every = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("start", "said", "learnt"))).alias("w"), F.sum("n_chars").alias("formatted_chars"))
    joined = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    rows = every.select("conv_id", "n_turns", joined("said").alias("said"), joined("learnt").alias("learnt"), "formatted_chars")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("conv_id", "n_turns", sha("said").alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), sha("learnt").alias("loss_sha256"), "formatted_chars")
