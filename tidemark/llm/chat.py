"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its text the only trainable part.
Turns after a conversation's last assistant turn, and conversations without one, get one more example in which nothing is
trainable, so that no turn is lost.

A turn is written ``[INST]role[/INST]``, line feed, text, line feed, ``</s>``; an example starts with ``<s>``. A control string
inside a role or text gets a backslash after its first character (and one more if it has some already), so none is left in
escaped text and ``unescape`` gives back the exact text.

All of it is DataFrame expressions; the only shuffle is by conversation. An example holds all turns before its target, so a
conversation must fit into a row.

Defined results: null role or text counts as empty; turns of one number, and repeated rows, all stay, ordered by role and
text; a null turn number sorts first; null conv_id is a conversation of its own; an empty table gives no example; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings: <s> </s> <<SYS>> <</SYS>> [INST] [/INST]
CONTROL = r"(<|\[)(\\*)(/?s>|</?SYS>>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|</?SYS>>|/?INST\])"
BEGIN, END = "<s>", "</s>"
ROLE, TEXT = "[INST]", "[/INST]\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv_id, target, formatted, loss_start, loss_end, is_last): code points [loss_start, loss_end) of formatted are
    trainable; both are null in an example without a target. is_last marks the example that holds every turn."""
    said = conversations.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns"))
    n = F.size("turns")
    made = said.select("conv_id", n.alias("n"), F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("trains"),
        F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    made = made.select("conv_id", "n", "parts", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n" + END))).alias("written"))
    one = made.select("conv_id", "n", "written", F.posexplode("parts").alias("target", "part"))
    one = one.where(F.col("part.trains") | (F.col("target") == F.col("n") - 1))
    before = F.concat(F.lit(BEGIN), F.array_join(F.slice("written", F.lit(1), F.col("target")), ""))
    one = one.select("conv_id", "n", "target", "part", before.alias("context"), F.get("written", F.col("target")).alias("own"))
    start = F.char_length("context") + F.char_length("part.head")
    return one.select("conv_id", F.col("target"), F.concat("context", "own").alias("formatted"),
                      F.when(F.col("part.trains"), start).alias("loss_start"),
                      F.when(F.col("part.trains"), start + F.char_length("part.body")).alias("loss_end"),
                      (F.col("target") == F.col("n") - 1).alias("is_last"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    pieces = F.split(formatted.substr(F.lit(len(BEGIN) + 1), F.char_length(formatted)), END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1).substr(F.lit(len(ROLE) + 1), F.char_length(p))).alias("role"),
        unescape(p.substr(F.char_length(F.substring_index(p, TEXT, 1)) + len(TEXT) + 1,
                          F.char_length(p) - F.char_length(F.substring_index(p, TEXT, 1)) - len(TEXT) - 1)).alias("text")))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example; null without a target."""
    return unescape(formatted.substr(start + 1, end - start))


def digest(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns and trainable texts as counts and SHA-256 digests."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    read = made.select("conv_id", "target", F.char_length("formatted").alias("chars"), turns.alias("turns"),
                       read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    read = read.select("conv_id", "target", "chars", "loss", F.size("turns").alias("n"), F.sha2(F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("digest"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target", "loss")))), lambda x: x["loss"]), "")
    out = read.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("digest").alias("turns_sha256"),
                                      said.alias("said"), F.sum("chars").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("said").cast("long").alias("loss_chars"),
                      F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")
