"""Chat formatting of conversations with typed content parts.

A message's content is an array of typed parts.  A visitor flattens them in order:
text stands as it is (escaped), and every image, audio or document part becomes a
numbered placeholder.  Beside the text it records each attachment's reference and
the number of tokens that the placeholder will expand to.

The template of a turn is ``<|turn|>role<|body|>content<|end|>``.  Control strings,
the template's own and those of other common templates, never appear in content:
each is broken by a mark after its first character, and the mark itself is doubled,
so that :func:`unescaped` gives back every text exactly.

The loss mask is a list of code point spans [start, stop) of the formatted string:
the content of each assistant turn.

All of it is DataFrame expressions.  A conversation is one row of the result, so its
turns meet in one group; that group is the output itself.

Defined cases: a null text or part is empty; a null role is an empty role; a null
turn comes first; turns with equal numbers stand in order of role, then content;
repeated rows stay; rows with a null id form one conversation; an empty table gives
no rows; other columns are ignored.  A part of an unknown type is an attachment like any
other, with a placeholder and a reference; it expands to no tokens, and so does an image,
audio or document part whose size is missing, as a count would be a guess.  A part without
a type is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
MARK = "␛"

# What a text must not hold as it stands.
CONTROL_STRINGS = ("<|", "|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

# Expansion of attachments, in tokens.
IMAGE_TILE, TOKENS_PER_TILE = 512, 85
TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 600


def escaped(text: Column) -> Column:
    """``text`` without any control string, reversibly."""
    out = F.replace(text, F.lit(MARK), F.lit(MARK + MARK))
    for c in CONTROL_STRINGS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}{MARK}-{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`: a mark and "-" vanish, two marks are one."""
    return F.regexp_replace(text, f"{MARK}(?:-|({MARK}))", "$1")


def text_parts(text: Column) -> Column:
    """Plain text as content of one part."""
    return F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), text, F.lit("ref"), F.lit(None), F.lit("width"), F.lit(None), F.lit("height"), F.lit(None), F.lit("seconds"), F.lit(None), F.lit("pages"), F.lit(None))).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """How many tokens the placeholder of an attachment stands for."""
    tiles = F.ceil(part["width"] / IMAGE_TILE) * F.ceil(part["height"] / IMAGE_TILE)
    return F.coalesce(
        F.when(part["type"] == "image", tiles * TOKENS_PER_TILE)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * TOKENS_PER_SECOND))
        .when(part["type"] == "document", part["pages"] * TOKENS_PER_PAGE),
        F.lit(0),
    ).cast("long")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per conversation of ``messages`` (conv_id, turn, role, parts):

    conv_id, formatted, loss_spans, attachments (type, ordinal, ref, tokens) in the
    order of their placeholders, and attachment_tokens.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("_body").asc_nulls_first()]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select("conv_id", "turn", F.col("role").alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    # what orders turns with equal numbers and roles: their content
    rows = rows.withColumn("_body", F.to_json("parts"))
    rows = rows.withColumn("_files", F.filter("parts", lambda p: ~_is_text(p)))
    rows = rows.withColumn("_seen", F.coalesce(F.sum(F.size("_files")).over(before), F.lit(0)).cast("int"))
    numbered = F.transform("parts", lambda p, i: F.struct(p.alias("p"), F.size(F.filter(F.slice("parts", 1, i + 1), lambda q: ~_is_text(q))).alias("k")))
    content = F.transform(
        numbered,
        lambda x: F.when(_is_text(x["p"]), escaped(F.coalesce(x["p"]["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escaped(x["p"]["type"]), F.lit(":"), (x["k"] + F.col("_seen")).cast("string"), F.lit("|>"))),
    )
    rows = rows.withColumn("_content", F.array_join(content, ""))
    head = F.concat(F.lit(TURN), escaped(F.coalesce("role", F.lit(""))), F.lit(BODY))
    rows = rows.withColumn("_head", F.length(head)).withColumn("_piece", F.concat(head, F.col("_content"), F.lit(END)))
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)).cast("long"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    files = F.transform("_files", lambda p, i: F.struct(p["type"].alias("type"), (F.col("_seen") + i + 1).alias("ordinal"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    begin = F.col("_at") + F.col("_head")
    span = F.when(F.col("role") == "assistant", F.struct(begin.alias("start"), (begin + F.length("_content")).alias("stop")))
    turns = F.array_sort(F.collect_list(F.struct("_place", "_piece", span.alias("span"), files.alias("files"))))
    grouped = rows.groupBy("conv_id").agg(turns.alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: t["files"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["_piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|body\|>", -1)
        return F.struct(unescaped(F.substring(halves[0], len(TURN) + 1, 1 << 30)).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.transform(loss_spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return F.array_join(parts, "")


def report(chats: DataFrame) -> DataFrame:
    """Counts and digests, read back from the output of :func:`format_chat`."""
    read = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
