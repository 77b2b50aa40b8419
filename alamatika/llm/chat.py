"""Chat formatting: every assistant turn becomes one training example.

The project has no dialogue records, so the operator is general: turns are rows
(conv_id, turn, role, text). An example holds all preceding turns as context, and only
the reply of its own turn is trainable. Built-in expressions only.

Template of a turn: ``### Role: text</turn>`` and a line feed. Inside roles and texts a
backslash is written ``\\e``, a second ``#`` in a row ``\\h``, ``</turn>`` as
``<\\s/turn>`` and, in roles, a colon ``\\c``. So neither ``###`` nor ``</turn>`` occurs
inside a text, and taking the codes back in the opposite order restores it exactly.

Cases: null texts and roles are empty strings; a null conv_id is a conversation of its
own; turns with equal numbers are ordered by role, then text, and repeated rows stay
separate turns; null turn numbers come first. Turns after the last reply (or of a
conversation without one) form a last example whose mask is empty, so nothing is lost.
An empty table gives an empty table; further columns are ignored. One conversation is
formatted in one row, as its text is one string; its examples are prefixes of that string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
# Control strings and their codes, in the order of escaping.
CODES = (("\\", "\\e"), ("##", "#\\h"), ("</turn>", "<\\s/turn>"))
ROLE_CODES = CODES + ((":", "\\c"),)
TRAINED_ROLE = "assistant"


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def header(role: Column) -> Column:
    """``### Role: ``; the first letter is raised, and the exact role can be read back
    because a role that starts with a capital is marked by a leading ``\\u``.
    """
    coded = escape(role, ROLE_CODES)
    raised = F.concat(F.upper(F.substring(coded, 1, 1)), F.substring(coded, 2, 1 << 30))
    lower_start = coded.rlike("^[a-z]")
    return F.concat(F.lit("### "), F.when(lower_start, raised).otherwise(F.concat(F.lit("\\u"), coded)), F.lit(": "))


def read_role(shown: Column) -> Column:
    exact = F.substring(shown, 3, 1 << 30)
    lowered = F.concat(F.lower(F.substring(shown, 1, 1)), F.substring(shown, 2, 1 << 30))
    return unescape(F.when(shown.startswith("\\u"), exact).otherwise(lowered), ROLE_CODES)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` text and ``replies``, the spans of trainable
    text as (start, length) in code points from 0.
    """
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # Offsets are lengths of what stands before: summed once along the sorted turns.
    gathered = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    pieces = gathered.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                header(t["role"]).alias("head"), escape(t["text"]).alias("body"),
                (t["role"] == TRAINED_ROLE).alias("trained"),
            ),
        ).alias("pieces"),
    )
    spans = F.aggregate(
        "pieces",
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
        ),
        lambda done, p: F.struct(
            (done["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + len(END)).alias("at"),
            F.when(
                p["trained"],
                F.concat(
                    done["spans"],
                    F.array(F.struct(
                        (done["at"] + F.char_length(p["head"])).alias("start"),
                        F.char_length(p["body"]).cast("long").alias("length"),
                    )),
                ),
            ).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return pieces.select(
        "conv_id",
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
        ).alias("formatted"),
        spans.alias("replies"),
    )


def expand_targets(turns: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example`` (from 0), ``text`` (context and reply with
    its end mark), ``mask_start`` and ``mask_length`` of the trainable code points in it.
    """
    whole = format_conversations(turns)
    total = F.char_length("formatted").cast("long")
    ends = F.transform(
        "replies",
        lambda s: F.struct(
            s["start"].alias("mask_start"), s["length"].alias("mask_length"),
            (s["start"] + s["length"] + len(END)).alias("end"),
        ),
    )
    last = F.coalesce(F.get(ends, F.size(ends) - 1)["end"], F.lit(0).cast("long"))
    rest = F.struct(
        total.alias("mask_start"), F.lit(0).cast("long").alias("mask_length"), total.alias("end")
    )
    examples = F.when(last < total, F.concat(ends, F.array(rest))).otherwise(ends)
    return whole.select(
        "conv_id", "formatted", F.posexplode(examples).alias("example", "span")
    ).select(
        "conv_id", "example",
        F.substring("formatted", F.lit(1), F.col("span.end").cast("int")).alias("text"),
        F.col("span.mask_start").alias("mask_start"),
        F.col("span.mask_length").alias("mask_length"),
    )


def read_turns(text: Column) -> Column:
    """Turns of a formatted text as an array of (role, text)."""
    parts = F.filter(F.split(text, END), lambda p: p != "")
    head = lambda p: F.substring_index(p, ": ", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            read_role(F.substring(head(p), len("### ") + 1, 1 << 30)).alias("role"),
            unescape(F.substring(p, F.char_length(head(p)) + 3, F.lit(1 << 30))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, the text under the loss masks
    in order, and the code points of all examples.

    Before the grouping every example but the longest is reduced to its masked text.
    """
    masked = F.substring(
        "text", (F.col("mask_start") + 1).cast("int"), F.col("mask_length").cast("int")
    )
    narrow = examples.select(
        "conv_id", "example", F.char_length("text").cast("long").alias("chars"),
        unescape(masked).alias("loss"), "text",
    )
    return narrow.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    ).select(
        "conv_id", read_turns(F.col("longest")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"),
        "formatted_chars",
    )
