"""Chat formatting by prefix-target expansion: every assistant turn becomes its own training example.

An example's text is the conversation up to and including that reply, in a template that marks turns; only the reply is
trainable (``target_start``, ``target_chars``: code points from 1). Turns after the last reply belong to no example, so a
conversation that does not end with a reply gets one more row without target. All built from DataFrame functions.

Defined cases: null text or role counts as empty; turns are ordered by (turn, role, text) with nulls first, and rows that
repeat a turn stay, one after the other; null ``conv_id`` is a conversation of its own; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    r"""Put one more backslash between ``<`` and ``|``: no control string is left, and ``unescape`` undoes it."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on the marker's line: line breaks are written as %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, is_last, text, target_start, target_chars) of (conv_id, turn, role, text)."""
    role, body = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("text", F.lit("")).alias("text"),
        role.alias("role"),
        F.concat(F.lit(OPEN), escape_role(role), F.lit("\n")).alias("head"),
        body.alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    tail = len(CLOSE) + 1
    long = (F.char_length("head") + F.char_length("body") + tail).cast("long")
    placed = turns.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(long).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.struct(
        "n",
        F.concat("head", "body", F.lit(CLOSE + "\n")).alias("piece"),
        (F.col("end") - tail - F.char_length("body") + 1).alias("start"),
        F.char_length("body").cast("long").alias("chars"),
        (F.col("role") == TRAINED_ROLE).alias("trained"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    kept = F.filter("turns", lambda t: t["trained"] | (t["n"] == F.size("turns")))
    one = whole.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("full"),
        F.size("turns").alias("all_turns"),
        F.transform(kept, lambda t: t.dropFields("piece")).alias("kept"),
    ).select("conv_id", "full", "all_turns", F.posexplode("kept").alias("example", "s"))
    end = F.col("s.start") - 1 + F.col("s.chars") + tail
    return one.select(
        "conv_id",
        "example",
        F.col("s.n").alias("n_turns"),
        (F.col("s.n") == F.col("all_turns")).alias("is_last"),
        F.substr("full", F.lit(1), end.cast("int")).alias("text"),
        F.when(F.col("s.trained"), F.col("s.start")).alias("target_start"),
        F.when(F.col("s.trained"), F.col("s.chars")).alias("target_chars"),
    )


def read_turns(text: Column) -> Column:
    """Turns (role, text) read back from a formatted text."""
    parts = F.slice(F.split(text, r"<\|im_start\|>"), 2, F.length(text) + 1)

    def one(part: Column) -> Column:
        at = F.instr(part, "\n")
        body = F.substr(part, at + 1, F.length(part) - at - (len(CLOSE) + 1))
        return F.struct(unescape_role(F.substr(part, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, one)


def read_target(text: Column, start: Column, chars: Column) -> Column:
    """The reply under the loss mask, unescaped; null without a mask."""
    return unescape(F.substr(text, start.cast("int"), chars.cast("int")))
