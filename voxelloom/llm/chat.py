"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is written as  <s>[ROLE]role[/ROLE]text</s> .  Control strings inside roles and texts are escaped by one more
"~" after their first character, so no text can end or open a turn, and taking one "~" away restores the text.

Content parts are flattened in order by one visitor: a text part gives its (escaped) text, an attachment a placeholder;
references and the number of tokens that each placeholder stands for are recorded beside the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, ROLE, END_ROLE = "<s>", "</s>", "[ROLE]", "[/ROLE]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
_NAMES = "s|ROLE|INST|SYS|IMG|AUDIO|DOC|PAD"
_CONTROL = rf"([<\[])(~*/?(?:{_NAMES})[>\]])"
_ESCAPED = rf"([<\[])~(~*/?(?:{_NAMES})[>\]])"

#: Type of the `parts` column that `format_chats` reads.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def text_parts(text: Column) -> Column:
    """A plain message as content parts: one text part."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
        none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def expanded(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens an attachment stands for: patches and row ends of an image, frames of audio, pages of a document; 1 if unknown."""
    rows, columns = F.ceil(part["height"] / patch), F.ceil(part["width"] / patch)
    counted = (F.when(part["type"] == "image", rows * (columns + 1))
               .when(part["type"] == "audio", F.ceil(part["seconds"] * audio_rate))
               .when(part["type"] == "document", part["pages"].cast("long") * page_tokens))
    return F.coalesce(F.when(counted < 0, F.lit(0)).otherwise(counted), F.lit(1)).cast("long")


def _kind(part: Column) -> Column:
    """Placeholder of a part; null for text."""
    found = F.lit(None).cast("string")
    for kind, mark in PLACEHOLDERS.items():
        found = F.when(part["type"] == kind, F.lit(mark)).otherwise(found)
    return found


def visit(parts: Column, patch: int = 16, audio_rate: float = 25.0, page_tokens: int = 256) -> tuple[Column, Column]:
    """(flat text, attachments) of the parts of one message, in order.

    Attachments are structs (kind, ref, nth, tokens); `nth` counts the placeholders of the message from 0.  A part of an
    unknown or null type is read as text; null texts are empty; null parts are left out.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    flat = F.array_join(F.transform(parts, lambda p: F.coalesce(_kind(p), escape(F.coalesce(p["text"], F.lit(""))))), "")
    media = F.filter(parts, lambda p: _kind(p).isNotNull())
    listed = F.transform(media, lambda p, i: F.struct(
        p["type"].alias("kind"), p["ref"].alias("ref"), i.alias("nth"), expanded(p, patch, audio_rate, page_tokens).alias("tokens")))
    return flat, listed


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                 trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens), one row a conversation.

    Turns are ordered by `turn`, ties by role and text; a null turn comes first, a null role is empty, a null text or
    `parts` is empty; rows with a null conv_id are one conversation; repeated rows are repeated turns.  loss_spans are code
    point ranges (end exclusive) of `formatted` that hold the text of the `trained` roles.  attachments add the turn's place
    to those of `visit`; expanded_tokens is their sum.

    A conversation is one string, so its turns meet in one task by nature; rows move once, keyed by conversation.
    """
    flat, listed = visit(F.col(parts))
    role_text = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), role_text.alias("role"), flat.alias("flat"), listed.alias("listed"))
    head = F.concat(F.lit(OPEN + ROLE), escape(F.col("role")), F.lit(END_ROLE))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "flat", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "flat")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("stop", F.sum(F.length("piece")).over(upto) - len(CLOSE))
    span = F.when(F.col("role").isin(*trained), F.struct((F.col("stop") - F.length("flat")).alias("start"), F.col("stop").alias("end")))
    chats = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("nth", "piece", "listed", span.alias("span")))).alias("turns"))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(t["listed"], lambda a: F.struct(
        (t["nth"] - 1).alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["nth"].alias("nth"), a["tokens"].alias("tokens")))))
    done = chats.select(
        "conv_id", "n_turns", F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"), attached.alias("attachments"))
    return done.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    start = len(OPEN + ROLE) + 1

    def turn(p):
        at = F.instr(p, END_ROLE)
        return F.struct(unescape(F.substr(p, F.lit(start), at - start)).alias("role"), unescape(F.substr(p, at + len(END_ROLE))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
