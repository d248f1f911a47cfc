"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Control strings of this and other
usual templates inside a role or a text are escaped: a backslash goes behind their first sign,
after all backslashes have been doubled, so that unescaping gives back every text exactly.

Every assistant turn becomes an example of its own: its text is all that precedes the turn,
then the turn; only the reply's own signs are under the loss mask. An example is a prefix of
the conversation, so it is cut from one formatted string and carries the mask as offsets. What
follows the last assistant turn, and a conversation without one, makes a last example with
an empty mask, so that the examples always hold the whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import only

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates give a meaning to. The first one begins the marks above.
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROLS):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """(conv_id, example_no, is_last, text, loss_start, loss_end), one row per example.

    Offsets count code points from 0; loss_start = loss_end where nothing is trainable. Rows of a
    conversation are ordered by turn (nulls first), then role and text, so ties and repeated rows
    have one order; null roles and texts count as empty. Rows with a null conv_id make one
    conversation. No rows, no examples. A conversation is formatted in one row, as its examples
    have to be; other columns are not looked at.
    """
    rows = only(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == target).alias("target"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    # ends of all turns: a running sum of their lengths
    length = lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long")
    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + length(p))))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    laid = parts.select("conv_id", "parts", ends.alias("ends"), text.alias("whole"))
    spans = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda k: F.struct(
            F.get("ends", k).alias("stop"),
            F.get("parts", k - 1)["target"].alias("target"),
            (F.get("ends", k) - len(END) - F.length(F.get("parts", k - 1)["body"])).alias("loss_start"),
            (F.get("ends", k) - len(END)).alias("loss_end"),
            (k == F.size("parts")).alias("is_last"),
        ),
    )
    wanted = laid.select("conv_id", "whole", F.posexplode(F.filter(spans, lambda s: s["target"] | s["is_last"])).alias("example_no", "s"))
    start = F.when(F.col("s.target"), F.col("s.loss_start")).otherwise(F.col("s.stop"))
    stop = F.when(F.col("s.target"), F.col("s.loss_end")).otherwise(F.col("s.stop"))
    return wanted.select("conv_id", F.col("example_no").cast("long").alias("example_no"), F.col("s.is_last").alias("is_last"), F.substring("whole", F.lit(1), F.col("s.stop").cast("int")).alias("text"), start.alias("loss_start"), stop.alias("loss_end"))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The text under the mask of an example, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def parse(text: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    pieces = F.filter(F.split(text, "<\\|end\\|>", -1), lambda p: p != "")
    cut = lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), "<\\|text\\|>", -1)
    return F.transform(F.transform(pieces, cut), lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, formatted_chars) of each conversation, from its examples alone."""
    own = formatted.select("conv_id", "example_no", F.when(F.col("is_last"), F.col("text")).alias("whole"), loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    one = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example_no", "loss", "whole"))).alias("e"))
    whole = F.element_at("e", -1)["whole"]
    return one.select("conv_id", parse(whole).alias("turns"), F.transform("e", lambda x: x["loss"]).alias("losses"), F.length(whole).cast("long").alias("formatted_chars"))
