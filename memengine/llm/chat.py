"""Operator 9: chat formatting with a grammar round trip, in DataFrame functions only.

Template, one segment for each turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.

Escapes. In roles and texts a control opener ``<|`` would be read as a mark; ``<`` with k tildes and ``|``
becomes ``<`` with k + 1 tildes and ``|``, which the parser takes back. In roles also ``\\`` becomes ``\\s``
and a line break ``\\n``. Both are one to one.

Round trip. A segment is first rendered as it is and parsed by the grammar; where the parsed turn differs
from the source, its content is escaped and parsed again. The result is identical for every input, and
``round_trip`` says so for the whole conversation, parsed from its final text.

The loss mask covers the text of each assistant turn: (offset in the segment, length), in characters.

Turns are rendered before the shuffle and put together in two steps, runs of ``run`` turn numbers first,
so that only finished blocks of a long conversation meet.

Defined results: null roles and texts are empty; turns of one number are ordered by role, then text; rows
that repeat are turns of their own; a null conversation id is a conversation like any other; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(~*)\|", r"<$1~|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<~(~*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape_text(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape_text(c), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(rendered: Column) -> Column:
    """array<struct<role, text, offset, chars>> of a rendered text: the grammar's deterministic parser.

    offset and chars are those of the (escaped) text inside its segment. A segment without the opening
    mark has a null role.
    """
    parts = F.split(rendered, F.lit("<\\|im_end\\|>\n"), -1)
    segments = F.filter(parts, lambda x, i: (i < F.size(parts) - 1) | (x != ""))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(head) + 2)
        role = F.when(head.startswith(START), unescape_role(F.substr(head, F.lit(len(START) + 1))))
        return F.struct(role.alias("role"), unescape_text(body).alias("text"), (F.length(head) + 1).alias("offset"), F.length(body).alias("chars"))

    return F.transform(segments, turn)


def format_chats(chats: DataFrame, run: int = 64) -> DataFrame:
    """(conv_id, formatted, segments array<struct<chars, loss_offset, loss_chars>>, round_trip)."""
    turns = chats.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def same(parsed: Column) -> Column:
        return (F.size(parsed) == 1) & parsed[0]["role"].eqNullSafe(F.col("role")) & parsed[0]["text"].eqNullSafe(F.col("text"))

    raw = render(F.col("role"), F.col("text"))
    safe = render(escape_role(F.col("role")), escape_text(F.col("text")))
    # A segment alone parses as it does among others only if it has no stray opener at all.
    clean = ~F.contains(F.col("text"), F.lit("<|")) & ~F.contains(F.col("role"), F.lit("<|"))
    turns = turns.withColumn("plain", clean & same(parse(raw))).withColumn("segment", F.when(F.col("plain"), raw).otherwise(safe))
    assistant = F.col("role") == "assistant"
    got = parse(F.col("segment"))[0]
    turns = turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "plain",
        F.struct(
            F.length("segment").cast("long").alias("chars"),
            F.when(assistant, got["offset"]).otherwise(0).cast("long").alias("loss_offset"),
            F.when(assistant, got["chars"]).otherwise(0).cast("long").alias("loss_chars"),
        ).alias("mask"),
        F.sha2(F.concat("role", F.lit("\n"), "text", F.lit("\n")), 256).alias("turn_digest"),
    )
    # Only the source text is shuffled; its segment is rendered again after it.
    entry = F.struct("turn", "role", "text", "plain", "mask", "turn_digest")

    def segment_of(x: Column) -> Column:
        return F.when(x["plain"], render(x["role"], x["text"])).otherwise(render(escape_role(x["role"]), escape_text(x["text"])))

    blocks = turns.groupBy("conv_id", F.floor(F.col("turn") / run).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("t"))
    blocks = blocks.select(
        "conv_id",
        F.struct(
            F.coalesce("block", F.lit(-(1 << 62))).alias("block"),
            F.array_join(F.transform("t", segment_of), "").alias("part"),
            F.col("t.mask").alias("masks"),
            F.col("t.turn_digest").alias("digests"),
        ).alias("b"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.col("b.part"), "").alias("formatted"),
        F.flatten("b.masks").alias("segments"),
        F.flatten("b.digests").alias("digests"),
    )
    recovered = F.transform(parse(F.col("formatted")), lambda x: F.sha2(F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")), 256))
    return whole.select("conv_id", "formatted", "segments", (recovered == F.col("digests")).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, round_trip) from the output."""
    turns = formatted.select("conv_id", "formatted", "segments", "round_trip", parse(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    pieces = F.split(F.col("formatted"), F.lit("(?<=<\\|im_end\\|>\n)"), -1)
    masked = F.zip_with(
        F.col("segments"),
        F.slice(pieces, 1, F.size("segments")),
        lambda m, x: F.when(m["loss_chars"] > 0, unescape_text(F.substr(x, (m["loss_offset"] + 1).cast("int"), m["loss_chars"].cast("int")))).otherwise(""),
    )
    return turns.withColumn("loss", F.array_join(masked, "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
