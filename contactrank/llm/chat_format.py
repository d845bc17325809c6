"""Operator 2: chat formatting by prefix-target expansion, on native columns only.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` per turn. Inside roles and texts a backslash is doubled and `<|`
becomes `<\\|`, so no control string can occur there; a line break in a role becomes `\\n`. Every assistant turn
becomes an example: all turns before it as context, and its text alone under the loss mask. Turns after the last
assistant turn end in one more example, whose mask is empty, so that nothing of a conversation is lost.

A conversation is one row while it is formatted. Its examples repeat each prefix, which is what the method makes;
they are built from turn strings that are escaped once, before the only shuffle.

Defined results: null texts and roles are empty; turns of equal number are ordered by role and text; repeated rows
are repeated turns; a null conversation id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column, one_line: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if one_line else out


def unescape(c: Column, one_line: bool = False) -> Column:
    """Between doubled backslashes, a single one marks what was escaped."""

    def piece(p: Column) -> Column:
        p = F.replace(p, F.lit("<\\|"), F.lit("<|"))
        return F.replace(p, F.lit("\\n"), F.lit("\n")) if one_line else p

    return F.array_join(F.transform(F.split(c, r"\\\\"), piece), "\\")


def format_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (0-based), formatted, loss_start and loss_end (code points of formatted)."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            role_.alias("role"),
            text_.alias("text"),
            F.concat(F.lit(START), escape(role_, True), F.lit("\n")).alias("head"),
            escape(text_).alias("body"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", "t", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))).alias("pieces"))
    ends = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (F.get("t", i)["role"] == "assistant") | (i == F.size("t") - 1))
    each = convs.select("conv_id", "t", "pieces", F.posexplode(ends).alias("example", "i"))
    target = F.get("t", F.col("i"))
    each = each.select("conv_id", "example", F.concat(F.array_join(F.slice("pieces", 1, F.col("i")), ""), target["head"]).alias("context"), target["body"].alias("body"), (target["role"] == "assistant").alias("trained"))
    begin = F.char_length("context")
    return each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat("context", "body", F.lit(END + "\n")).alias("formatted"),
        begin.cast("long").alias("loss_start"),
        (begin + F.when(F.col("trained"), F.char_length("body")).otherwise(0)).cast("long").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """From the examples alone: conv_id, turns (role and text, from the longest example), loss_text, formatted_chars."""
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    whole = examples.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.slice(F.split("last", r"<\|im_start\|>"), 2, F.size(F.split("last", r"<\|im_start\|>")))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        rest = F.substring(p, F.char_length(head) + 2, F.char_length(p) - F.char_length(head) - 1 - len(END) - 1)
        return F.struct(unescape(head, True).alias("role"), unescape(rest).alias("text"))

    return whole.select("conv_id", F.transform(parts, turn).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
