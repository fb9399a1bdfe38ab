"""Chat formatting by prefix-target expansion. DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it as the text, only its own reply under the loss. A conversation that doesn't end
with an assistant turn has one more example, of all its turns, with nothing under the loss; so each turn can be read back.

A turn is written as ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline. In a text, a backslash is doubled and
``<|`` becomes ``<\\|``: no control string is left, and taking each backslash away that stands before a character gives the text back. Roles are
percent-encoded, which leaves plain names as they are.

Turns go by turn, then role, then text; null texts and roles are empty; a null turn goes first; rows with a null conv_id make up one
conversation. An empty table has no examples. A conversation's turns come together in one row, as its digest needs; conversations, not
the table, bound that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_chars (code points in text; the escaped reply)."""
    none = F.lit("")
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), none).alias("role"), F.coalesce(F.col(text_col), none).alias("text"))
    convs = turns.select(F.col(conv_col).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    written = convs.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END))).alias("w"),
        F.transform("ts", lambda t: F.when(t["role"] == trained, F.length(escaped(t["text"]))).otherwise(F.lit(-1))).alias("size"),
    )
    targets = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (F.element_at("size", i) >= 0) | (i == F.size("w")))
    each = written.select("conv_id", "w", "size", F.posexplode(targets).alias("example", "last"))
    text = F.array_join(F.slice("w", F.lit(1), F.col("last")), "")
    loss = F.element_at("size", F.col("last"))
    return each.select("conv_id", F.col("example"), text.alias("text"), loss.alias("loss")).select(
        "conv_id",
        "example",
        "text",
        F.when(F.col("loss") >= 0, F.length("text") - F.col("loss") - len(END)).otherwise(0).cast("long").alias("loss_start"),
        F.greatest(F.col("loss"), F.lit(0)).cast("long").alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        return F.struct(F.url_decode(F.substring(role, F.lit(len(START) + 1), F.length(role))).alias("role"), unescaped(F.substring(part, F.length(role) + 2, F.length(part))).alias("text"))

    return F.transform(parts, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    loss = unescaped(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    whole = formatted.withColumn("loss", loss).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum(F.length("text")).alias("formatted_chars"), F.count_if(F.col("loss_start") > 0).alias("n_examples")
    )
    turns = whole.withColumn("turns", read_turns(F.col("text"))).withColumn("learned", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
