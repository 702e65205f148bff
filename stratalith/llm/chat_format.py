"""Operator 7, chat formatting, in DataFrame expressions only.

The turns of a conversation are collected as structs, sorted by (turn, role, text), and written as
``<|im_start|>role\\ntext<|im_end|>\\n``; adjacent turns of one role share a pair of marks and are parted by
``<|im_sep|>``. Inside texts every ``<`` followed by backslashes and ``|`` gets one more backslash, so that no text can
hold a mark, and taking one away restores it; line ends and backslashes of roles are written as ``\\n`` and ``\\\\``.

The result of a conversation is its segments: pieces of the formatted text with a flag, whether the loss counts for
them. The flags are the loss mask, run by run; the pieces joined are the formatted text. Each step is linear in the
turns: array functions look at a turn's neighbour by index, and nothing is folded into a growing value.

Defined results: null texts and roles are empty ones; turns with equal numbers are ordered by role and text, repeated
rows stay; a null conversation id is an id of its own; further columns are ignored; an empty table gives no rows.
One conversation is one row, so one of more than 2 GB can't be formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEPARATOR = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, segments (text, loss), formatted."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("turns"), i - 1)["role"] == t["role"])
        ends = F.when(i > 0, F.lit(END)).otherwise(F.lit(""))
        mark = F.when(same, F.lit(SEPARATOR)).otherwise(F.concat(ends, F.lit(START), escaped_role(t["role"]), F.lit("\n")))
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")), F.struct(escaped(t["text"]).alias("text"), (t["role"] == TRAINED_ROLE).alias("loss")))

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    rows = grouped.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces)), last).alias("segments"))
    return rows.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""

    def block(b: Column) -> Column:
        role = unescaped_role(F.substring_index(b, "\n", 1))
        body = F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)
        body = F.substr(body, F.lit(1), F.length(body) - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda b: F.length(b) > 0)
    return F.flatten(F.transform(blocks, block))


def under_loss(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, turns and loss_text as the formatted text and its mask say."""
    return rows.select("conv_id", parsed(F.col("formatted")).alias("turns"), under_loss(F.col("segments")).alias("loss_text"), "formatted")
