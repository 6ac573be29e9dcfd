"""Chat transcripts as training examples, one for every assistant turn.

Prefix-target expansion: each assistant turn becomes an example of its own. Its
text is all preceding turns, then the reply; the loss mask ``[loss_start,
loss_end)`` covers the reply alone, in code points of ``text``. A conversation
that does not end with an assistant turn gets one more example without a mask, so
that no turn is lost; it is the last one, as ``whole`` says.

Template of a turn::

    ### role: text</turn>\\n

``###`` opens a turn and ``</turn>`` closes it. Inside roles and texts a backslash
is doubled and every control string is broken by a backslash (``#\\#`` for two hashes,
``<\\/turn>``), so an unbroken control string is always a mark and dropping the
backslashes gives the text back. A role's ``: `` is broken too.

The turns of a conversation meet in one row, because an example is one row with all
of them. Examples are exploded from that row one after the other: memory follows
the longest conversation, the written text the sum of its prefixes.

Defined results: turns are ordered by number, null first, then by role and text, so
repeated rows are turns of their own; a null role or text is empty; the rows without
a conv_id are one conversation; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    opened = F.replace(doubled, F.lit("##"), F.lit("#\\#"))
    return F.replace(opened, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    name = F.replace(escape(role), F.lit(BETWEEN), F.lit(":\\ "))
    return F.concat(F.lit(OPEN), name, F.lit(BETWEEN), escape(text), F.lit(CLOSE))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text holds."""
    # What follows the last mark is empty.
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        at = F.locate(BETWEEN, piece)
        role = piece.substr(F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        text = F.substring(piece, at + F.lit(len(BETWEEN)), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), text, loss_start, loss_end, whole."""
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    pieces = turns.select(
        "conv_id",
        F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("pieces"),
        # Places, from 1, after which an example ends.
        F.filter(
            F.transform(
                "turns", lambda t, i: F.when(t["role"] == ASSISTANT, i + 1).otherwise(F.lit(0))
            ),
            lambda i: i > 0,
        ).alias("replies"),
        F.size("turns").alias("n"),
    )
    ends = pieces.withColumn("ends", F.array_union("replies", F.array("n")))
    cut = ends.select(
        "conv_id",
        "pieces",
        "n",
        F.size("replies").alias("masked"),
        F.posexplode("ends").alias("place", "end"),
    )
    text = F.array_join(F.slice("pieces", F.lit(1), F.col("end")), "")
    head = len(OPEN) + len(ASSISTANT) + len(BETWEEN) + len(CLOSE)
    reply = F.length(F.element_at("pieces", F.col("end"))) - F.lit(head)
    made = cut.select(
        "conv_id",
        (F.col("place") + 1).cast("long").alias("example"),
        text.alias("text"),
        F.when(F.col("place") < F.col("masked"), reply).alias("reply"),
        (F.col("end") == F.col("n")).alias("whole"),
    )
    # Without a reply the mask is empty, at the end of the text.
    size = F.length("text")
    stop = F.when(F.col("reply").isNull(), size).otherwise(size - F.lit(len(CLOSE)))
    return made.select(
        "conv_id",
        "example",
        "text",
        (stop - F.coalesce("reply", F.lit(0))).cast("long").alias("loss_start"),
        stop.cast("long").alias("loss_end"),
        "whole",
    )


def read_back(made: DataFrame) -> DataFrame:
    """Digests per conversation, read from the text and mask of its examples.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The
    last example holds all turns; each mask gives one reply. ``formatted_chars``
    counts the text of all examples.
    """
    turns = read_turns(F.col("text"))
    listed = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    masked = F.substring(
        "text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")
    )
    each = made.select(
        "conv_id",
        "example",
        unescape(masked).alias("reply"),
        F.length("text").alias("chars"),
        F.when(F.col("whole"), F.size(turns).cast("long")).alias("n_turns"),
        F.when(F.col("whole"), F.sha2(listed.cast("binary"), 256)).alias("turns_sha256"),
    )
    grouped = each.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda r: r["reply"]
            ),
            "",
        ).alias("reply"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("reply").cast("long").alias("loss_chars"),
        F.sha2(F.col("reply").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
