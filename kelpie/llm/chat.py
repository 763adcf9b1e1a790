"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all turns before it are its context, written out, and only its reply
is trainable. The examples of a conversation of n turns take n**2 turns. A turn is formatted once, with its offset in
its conversation's transcript; a conversation is gathered and expanded within a task, so the examples cross no
shuffle. Turns after the last reply are in the transcript and in no example.

    <|im_start|>role LF text <|im_end|> LF

Control strings inside texts are escaped reversibly: each "<" + backslashes + "|" gets one more backslash. A
role may hold neither "<|" nor a line feed after escaping. DataFrame functions only.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), null turns first, so
ties and repeated rows keep one order; conversations without a reply give no example; a null conv_id is a
conversation of its own; an empty table gives no turns. A very long text is one turn; a very long conversation is
formatted turn by turn and gathered into one row for its examples, which has to fit a task; of the examples one at a time
is in memory. Only conv_id, turn, role and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm.common import text_or_empty

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    # a backslash that is not part of an escaped pair marks a line feed: pairs are parked as NUL + "b" first
    parked = F.replace(F.replace(c, F.lit("\0"), F.lit("\0z")), F.lit("\\\\"), F.lit("\0b"))
    back = F.replace(F.replace(F.replace(parked, F.lit("\\n"), F.lit("\n")), F.lit("\0b"), F.lit("\\")), F.lit("\0z"), F.lit("\0"))
    return unescape(back)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, segment, loss_start, loss_chars, trainable, ordinal, start.

    segment is the formatted turn, start its offset in the transcript; loss_start and loss_chars are the trainable
    span inside the segment (loss_chars 0 for turns that are no replies). One shuffle by conv_id, of the turns as they
    are given; numbers and offsets come from one window over sorted rows, which streams and spills.
    """
    turns = conversations.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text")).repartition(F.col("conv_id"))
    header = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    reply = F.col("role") == "assistant"
    formatted = turns.select("*", header.alias("header"), escape(F.col("text")).alias("body")).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat("header", "body", F.lit(END + "\n")).alias("segment"),
        F.length("header").alias("loss_start"),
        F.when(reply, F.length("body")).otherwise(0).alias("loss_chars"),
        reply.alias("trainable"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return formatted.withColumns({"ordinal": F.row_number().over(order), "start": F.coalesce(before, F.lit(0).cast("long"))}).drop("role", "text")


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns, transcript: a conversation's formatted turns in order, and their segments as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "segment", "start", "loss_start", "loss_chars", "trainable")))
    whole = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    return whole.withColumn("transcript", F.array_join(F.transform("turns", lambda s: s["segment"]), ""))


def expand(turns: DataFrame, with_whole: bool = False) -> DataFrame:
    """One row per reply: conv_id, example, context_chars, context, target, loss_start, loss_chars.

    The example's text is context followed by target; the loss mask covers loss_chars characters of target from
    loss_start. With with_whole, each conversation has one row more, without example and target, whose context is its
    whole transcript. Size: replies x transcript.
    """
    example = lambda s: F.struct(s["ordinal"].alias("example"), s["start"].alias("context_chars"), s["segment"].alias("target"), s["loss_start"].alias("loss_start"), s["loss_chars"].alias("loss_chars"))
    rows = F.transform(F.filter("turns", lambda s: s["trainable"]), example)
    if with_whole:
        none = lambda k, t: F.lit(None).cast(t).alias(k)
        end = F.struct(none("example", "int"), F.length("transcript").cast("long").alias("context_chars"), none("target", "string"), none("loss_start", "int"), none("loss_chars", "int"))
        rows = F.concat(rows, F.array(end))
    out = gathered(turns).select("conv_id", "transcript", F.explode(rows).alias("row")).select("conv_id", "transcript", "row.*")
    return out.select("conv_id", "example", "context_chars", upto("transcript", "context_chars").alias("context"), "target", "loss_start", "loss_chars")


def upto(text: str, n: str) -> Column:
    return F.substring(F.col(text), F.lit(1), F.col(n).cast("int"))


def transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, transcript: the segments of a conversation in order."""
    return gathered(turns).select("conv_id", "transcript")


def render(turns: DataFrame) -> DataFrame:
    """The examples' texts: conv_id, example, context, target, loss_start, loss_chars."""
    return expand(turns).drop("context_chars")


def parse(segment: Column) -> tuple[Column, Column]:
    """Role and text, read back from a formatted turn."""
    role = F.regexp_extract(segment, r"(?s)^<\|im_start\|>([^\n]*)\n", 1)
    text = F.regexp_extract(segment, r"(?s)^<\|im_start\|>[^\n]*\n(.*)<\|im_end\|>\n$", 1)
    return unescape_role(role), unescape(text)


def starts(text: Column) -> Column:
    """The formatted turns of a text: escaped texts and roles hold no START."""
    return F.transform(F.filter(F.split(text, r"<\|im_start\|>", -1), lambda s: s != ""), lambda s: F.concat(F.lit(START), s))


def digest(turns: DataFrame) -> DataFrame:
    """What the formatted output holds, read back from it: turns from the transcript, replies from the examples' texts under the mask.

    formatted_chars is the size of the transcript. Each example's context has to be the transcript up to its target, by
    digest, its target what follows there, its number that of the turns before it and one, and each reply has to have
    its example; anything else is an error.
    """
    rows = expand(turns, with_whole=True)
    said_under_mask = F.substring(F.concat("context", "target"), F.length("context") + F.col("loss_start") + 1, F.col("loss_chars"))
    example = F.struct(
        "example", "context_chars", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"), (F.size(starts(F.col("context"))) + 1).alias("place"), "target", unescape(said_under_mask).alias("reply")
    )
    met = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), example))).alias("examples"), F.first(F.when(F.col("example").isNull(), F.col("context")), ignorenulls=True).alias("transcript")
    )
    read = met.withColumn("turns", F.transform(starts(F.col("transcript")), lambda s: F.struct(*(c.alias(k) for k, c in zip(("role", "text"), parse(s), strict=True)))))
    stands = F.expr(
        """forall(examples, e -> e.example = e.place AND e.context_sha256 = sha2(cast(substring(transcript, 1, int(e.context_chars)) AS binary), 256)
             AND e.target = substring(transcript, int(e.context_chars) + 1, length(e.target)))"""
    )
    whole = F.size("examples") == F.size(F.filter("turns", lambda t: t["role"] == "assistant"))
    replies = F.array_join(F.transform("examples", lambda e: e["reply"]), "")
    joined = read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.when(stands & whole, replies).otherwise(F.raise_error(F.lit("an example does not stand where its context ends"))).alias("replies"),
        F.length("transcript").cast("long").alias("formatted_chars"),
    )
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("replies").cast("long").alias("loss_chars"),
        F.sha2(F.col("replies").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
