"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, then the reply, which alone is
under the loss mask. A conversation that doesn't end with an assistant turn also gives a last example of all its
turns with an empty mask, so that every turn is in the output.

Template: ``[INST] user [/INST]``, ``<s>assistant</s>``, ``[SYS] system [/SYS]``, ``[ROLE:x] other [/ROLE]``. A control
string inside a text has its first character replaced by an escape mark and a letter; the mark itself is
doubled in the same way, so texts without either are unchanged and all come back exactly.

Scale: built-in functions only. One shuffle by conv_id; examples are made and read back in the same stage. An
example holds its whole context by definition, so a conversation's output grows with the square of its turns; rows
are made one at a time from the conversation's turns, and no two examples are held together.

Edge cases: null text or role is empty; turns of equal number go by role and text, null turn first; repeated rows are
separate turns. A null conv_id is a conversation of its own. Extra columns are ignored. Empty table, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "␛"
#: Control strings, with the letter that stands for their first character.
CONTROLS = (("<s>", "l"), ("</s>", "l"), ("[INST]", "b"), ("[/INST]", "b"), ("[SYS]", "b"), ("[/SYS]", "b"), ("[ROLE:", "b"), ("[/ROLE]", "b"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit(MARK), F.lit(MARK + "e"))
    for control, letter in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(MARK + letter + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for letter, first in (("l", "<"), ("b", "["), ("e", MARK)):
        text = F.replace(text, F.lit(MARK + letter), F.lit(first))
    return text


def _open(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE:"), F.replace(escape(role), F.lit("]"), F.lit(MARK + "c")), F.lit("] "))
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s>").when(role == "system", "[SYS] ").otherwise(other)


def _close(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").when(role == "system", " [/SYS]").otherwise(" [/ROLE]")


def examples(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position, text, loss_start, loss_length)``: positions count turns from 0, offsets code points."""
    role, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), said.alias("text"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), _open(t["role"]).alias("open"), escape(t["text"]).alias("text"), _close(t["role"]).alias("close"))).alias("turns"),
    )
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == "assistant") | (i == last))
    at = made.select("conv_id", "turns", F.explode(targets).alias("position"))
    parts = at.select(
        "conv_id",
        "position",
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("position")), lambda t: F.concat(t["open"], t["text"], t["close"])), "").alias("context"),
        F.get("turns", F.col("position")).alias("t"),
    )
    return parts.select(
        "conv_id",
        "position",
        F.concat("context", "t.open", "t.text", "t.close").alias("text"),
        (F.length("context") + F.length("t.open")).alias("loss_start"),
        F.when(F.col("t.role") == "assistant", F.length("t.text")).otherwise(0).alias("loss_length"),
    )


_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|\[SYS\] .*? \[/SYS\]|\[ROLE:[^\]]*\] .*? \[/ROLE\]"


def parse(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""

    def one(s: Column) -> Column:
        role = (
            F.when(F.startswith(s, F.lit("[INST]")), "user").when(F.startswith(s, F.lit("<s>")), "assistant").when(F.startswith(s, F.lit("[SYS]")), "system")
            .otherwise(unescape(F.replace(F.regexp_extract(s, r"^\[ROLE:([^\]]*)\]", 1), F.lit(MARK + "c"), F.lit("]"))))
        )
        head = F.when(F.startswith(s, F.lit("[ROLE:")), F.length(F.regexp_extract(s, r"^\[ROLE:[^\]]*\] ", 0))).when(F.startswith(s, F.lit("<s>")), 3).when(F.startswith(s, F.lit("[SYS]")), 6).otherwise(7)
        tail = F.when(F.startswith(s, F.lit("<s>")), 4).when(F.startswith(s, F.lit("[SYS]")), 7).otherwise(8)
        inner = F.substring(s, head + 1, F.length(s) - head - tail)
        return F.struct(role.alias("role"), unescape(inner).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), one)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, loss text and size."""
    loss = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_length")))
    groups = formatted.groupBy("conv_id").agg(
        F.max_by("text", "position").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return groups.withColumn("turns", parse(F.col("longest"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
