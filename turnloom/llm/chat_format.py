"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered array of parts. Each part is visited by its kind: texts are escaped,
attachments become one placeholder each, in order, while their references and expanded token
counts are recorded. The template marks turns with control strings; inside texts these are escaped
by one more backslash after their first character, which unescaping takes away again.

Defined cases: a null text, role or part list counts as empty; turns are ordered by (turn, role,
unescaped text) with nulls first, so ties and repeated rows have one order; an unknown kind of part is shown
as a text; a null conv_id is a conversation of its own; no turns give no conversations. Turns are
rendered row by row before they meet, and a conversation's output is one row, so one conversation
must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, and those of common chat templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = r"\|(?:turn|text|end|image|audio|document)\|>|/?s>|/?INST\]|</?SYS>>"

PARTS = (
    "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>")
#: Expanded tokens: image patches of so many pixels a side, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 14, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROLS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROLS})", "$1$2$3")


def text_part(text: Column) -> Column:
    """A plain text as a part list."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("bigint").alias("pages"))).cast(PARTS)


def visit(part: Column) -> Column:
    """What a part shows in the output."""
    shown = escape(F.coalesce(part["text"], F.lit("")))
    for kind, placeholder in PLACEHOLDERS.items():
        shown = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(shown)
    return shown


def expanded(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for, one at least."""
    def patches(side: str) -> Column:
        return F.ceil(F.coalesce(part[side], F.lit(0)) / PATCH)

    n = F.lit(0).cast("bigint")
    n = F.when(part["kind"] == "image", patches("width") * patches("height")).otherwise(n)
    n = F.when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES)).otherwise(n)
    n = F.when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE).otherwise(n)
    return F.greatest(n, F.lit(1)).cast("bigint")


def attachments(parts: Column) -> Column:
    """Kind, reference, place among the turn's attachments and expanded tokens, in order."""
    kept = F.filter(parts, lambda p: F.coalesce(p["kind"].isin(*PLACEHOLDERS), F.lit(False)))
    return F.transform(kept, lambda p, i: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), i.alias("place"), expanded(p).alias("n_tokens")))


def rendered(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per turn: its piece of the output, the part of it under the loss mask, attachments.

    loss_start (from 0) and loss_length count code points inside the piece.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else text_part(F.col("text").cast("string"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            role.alias("role"), F.coalesce(parts, F.array().cast(PARTS)).alias("parts"))
        .select(
            "conv_id", "turn", "role",
            F.array_join(F.transform("parts", visit), "").alias("content"),
            F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("said"),
            attachments(F.col("parts")).alias("attachments"))
        .select(
            "conv_id",
            F.struct(
                "turn", "role", "said", "content", "attachments",
                (F.length(escape(F.col("role"))) + len(TURN) + len(TEXT)).alias("loss_start"),
                F.when(F.col("role") == trained_role, F.length("content")).otherwise(0).alias("loss_length"),
            ).alias("piece")))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: its pieces in order with their loss spans, and attachments."""
    pieces = F.sort_array(F.collect_list("piece"))
    shown = F.transform("pieces", lambda p: F.struct(
        F.concat(F.lit(TURN), escape(p["role"]), F.lit(TEXT), p["content"], F.lit(END)).alias("piece"),
        p["loss_start"].alias("loss_start"), p["loss_length"].alias("loss_length")))
    return (
        rendered(turns, trained_role).groupBy("conv_id").agg(pieces.alias("pieces"))
        .select("conv_id", shown.alias("pieces"),
                F.flatten(F.transform("pieces", lambda p: p["attachments"])).alias("attachments"))
        .withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["piece"]), "")))


def read_turns(formatted: Column) -> Column:
    """Roles and unescaped texts of a formatted conversation, as an array in order."""
    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|text\|>", 2)
        return F.struct(
            unescape(halves[0]).alias("role"),
            unescape(F.substring_index(halves[1], END, 1)).alias("text"))

    return F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30), turn)


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(pieces, lambda p: unescape(F.substr(p["piece"], p["loss_start"] + 1, p["loss_length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns read back from the output."""
    turns = read_turns(F.col("formatted"))
    told = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        chats.select("conv_id", "formatted", turns.alias("_turns"), read_loss(F.col("pieces")).alias("_loss"))
        .select(
            "conv_id", F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars")))
