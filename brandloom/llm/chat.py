"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written <s>role[INST]text[/INST]</s>. Inside roles and texts these four control strings get a backslash after
their first character, and backslashes are doubled, so that no text can forge a turn and every text can be read back.
Each assistant turn becomes an example of its own: all preceding turns, then this turn, of which only the reply is
trainable (mask_start, mask_chars: code points of the example's text). Turns after the last assistant turn are kept in a
closing example without a trainable part. A conversation is the unit: an example holds all turns before its reply, so
one conversation's turns are gathered in one row.

Edge cases: a null text or role is empty. Turns with equal numbers follow each other by role, then text. Repeated rows
are repeated turns. A null conv_id is a conversation of its own. A conversation without an assistant turn has one example
with nothing trainable. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY = "assistant"
OPEN, BODY, CLOSE = "<s>", "[INST]", "[/INST]</s>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"\[(/?INST\])", r"[\\$1"), "<(/?s>)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_col, example (0, 1, ...), text, mask_start (from 0), mask_chars, is_last: the examples of every conversation."""
    none = F.lit("")
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, none).alias("role"), F.coalesce(text_col, none).alias("text")).alias("t"),
    )
    convs = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY))
    parts = convs.select(
        "conv",
        F.transform("turns", lambda t: F.struct(F.concat(head(t), escape(t["text"]), F.lit(CLOSE)).alias("text"), F.length(head(t)).alias("head"), (t["role"] == REPLY).alias("reply"))).alias("parts"),
    )
    ends = F.transform("parts", lambda p, i: F.struct(i.alias("at"), p["reply"].alias("reply"), p["head"].alias("head"), F.length(p["text"]).alias("chars"), (i == F.size("parts") - 1).alias("is_last")))
    chosen = F.filter(ends, lambda e: e["reply"] | e["is_last"])
    one = parts.select("conv", "parts", F.posexplode(chosen).alias("example", "e"))
    text = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("e.at") + 1), lambda p: p["text"]), "")
    shown = one.select("conv", "example", "e", text.alias("text"))
    mask_chars = F.when(F.col("e.reply"), F.col("e.chars") - F.col("e.head") - len(CLOSE)).otherwise(0)
    mask_start = F.when(F.col("e.reply"), F.length("text") - len(CLOSE) - mask_chars).otherwise(F.length("text"))
    return shown.select(F.col("conv").alias(conv_col), "example", "text", mask_start.alias("mask_start"), mask_chars.alias("mask_chars"), F.col("e.is_last").alias("is_last"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pattern = F.lit(r"(?s)<s>(.*?)\[INST\](.*?)\[/INST\]</s>")
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), unescape).alias("text"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user and an assistant who say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"), F.lit(said).alias("text"))


def digest(formatted: DataFrame, conv_col="conv_id") -> DataFrame:
    """The columns of the op6 query, read back from the examples."""
    turns = F.when(F.col("is_last"), read_turns(F.col("text")))
    read = formatted.select(
        conv_col, "example", F.length("text").cast("long").alias("chars"),
        F.size(turns).alias("n"), F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        unescape(F.expr("substring(text, mask_start + 1, mask_chars)")).alias("loss"),
    )
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    whole = read.groupBy(conv_col).agg(F.max("n").alias("n"), F.max("said").alias("said"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        conv_col, F.col("n").cast("long").alias("n_turns"), F.sha2(F.col("said"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )
