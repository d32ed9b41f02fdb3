"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every control string of the template holds one of these, and no escaped text holds any.
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "[": "&lsqb;"}
END = "</s>\n"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES.items():
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))


def prefix_examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """Expand conversations: every turn of the target role is an example of its own.

    An example's text has all preceding turns as context and ends with its reply; loss_start
    and loss_end (code points) mark the reply alone.  A conversation that does not end with a
    target turn gives one more example of all its turns with an empty mask, so that the output holds
    every turn.  Rows are ordered by turn, then role, then text, nulls first; rows that repeat
    are turns of their own; null role and text are empty; rows with a null conv_id make up one
    conversation; other columns are ignored.  Returns conv_id, example (from 0), n_turns, text,
    loss_start, loss_end, last.  The text of a conversation's examples grows with the
    square of its turns: that is what the expansion is.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(opening(t["role"]), escape(t["text"]), F.lit(END))).alias("parts"))
    wanted = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.get("turns", i - 1)["role"] == target) | (i == F.size("turns")))
    rows = convs.select("conv_id", "turns", "parts", F.posexplode(wanted).alias("example", "n_turns"))
    own = F.get("turns", F.col("n_turns") - 1)
    text = F.array_join(F.slice("parts", F.lit(1), F.col("n_turns")), "")
    rows = rows.select("conv_id", "example", "n_turns", text.alias("text"), (own["role"] == target).alias("trains"), F.length(escape(own["text"])).alias("n"), (F.col("n_turns") == F.size("turns")).alias("last"))
    end = F.when(F.col("trains"), F.length("text") - len(END)).otherwise(F.length("text"))
    return rows.select("conv_id", "example", "n_turns", "text", (end - F.when(F.col("trains"), F.col("n")).otherwise(0)).alias("loss_start"), end.alias("loss_end"), "last")


def read_turns(text: Column) -> Column:
    """Turns (role, text) of an example's text."""
    parts = F.filter(F.split(text, END), lambda x: x != "")
    body = lambda x: F.substring_index(x, "<|", -1)
    return F.transform(parts, lambda x: F.struct(unescape(F.substr(body(x), F.lit(1), F.instr(body(x), F.lit("|>\n")) - 1)).alias("role"), unescape(F.substr(body(x), F.instr(body(x), F.lit("|>\n")) + 3)).alias("text")))


def loss_text() -> Column:
    return unescape(F.substr(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
