"""Conversations of typed content parts as one training string each, with attachments and a loss mask.

A turn's content is an array of parts (``PART``): text, image, audio or document. The
visitor joins the texts of neighbouring parts, escapes them as one, so that no control string arises where parts
meet, and makes the others placeholders; their references are recorded in order with the number of tokens they expand to. A turn is
``[INST]role\\ntext[/INST]``, or ``<s>assistant\\ntext</s>`` for the assistant; the mask
covers the assistant's texts alone. Inside texts and roles ``%`` becomes ``%25`` and the first
character of a control string ``%3C`` or ``%5B`` (a role's line break ``%0A``), which is undone exactly. A text that reads
like a placeholder is escaped, so it comes back as text and a placeholder as an attachment.

Everything here is column expressions. Turns are formatted before they meet: the group
of a conversation only joins finished pieces; one conversation is one string (Spark's limit for a value is 2 GB).

Edge cases: null texts and roles are empty, null part arrays have no part, a part of unknown
kind or with a null kind is an empty text. Null turns come first; equal turns are ordered
by role, then text; repeated rows are repeated turns; null conversation ids form one
conversation. An empty table gives an empty table. Extra columns are not read. An image without size, audio
without length or a document without pages counts one token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqweave.storage import materialize

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Side of an image patch in pixels, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 256
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
#: What stands for a placeholder until texts are escaped; no text holds a ``%`` by then but in ``%25``.
_MARKS = {kind: "%" + kind[0] for kind in PLACEHOLDERS}
_ANGLE = r"<(?=/?s>|(?:image|audio|document)>)"
_SQUARE = r"\[(?=/?INST\])"
ASSISTANT = "assistant"


def without_controls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "%3C"), _SQUARE, "%5B")


def escaped(text: Column) -> Column:
    return without_controls(F.replace(text, F.lit("%"), F.lit("%25")))


def unescaped(text: Column) -> Column:
    for code, char in (("%0A", "\n"), ("%3C", "<"), ("%5B", "["), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """An array of one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), none("string").alias("uri"), none("int").alias("width"),
            none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"),
        )
    )


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    size = F.when(part["kind"] == "image", image).when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).otherwise(part["pages"] * PAGE_TOKENS)
    return F.greatest(F.lit(1), F.coalesce(size, F.lit(1))).cast("long")


def flattened(parts: Column) -> Column:
    """The visitor: the parts' text in order."""

    def visit(part: Column) -> Column:
        out = F.when(part["kind"] == "text", F.replace(F.coalesce(part["text"], F.lit("")), F.lit("%"), F.lit("%25")))
        for kind, mark in _MARKS.items():
            out = out.when(part["kind"] == kind, F.lit(mark))
        return out.otherwise(F.lit(""))

    joined = F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), "")
    text = without_controls(joined)
    for kind, mark in _MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(PLACEHOLDERS[kind]))
    return text


def attachments(parts: Column) -> Column:
    """The attachments in order: kind, reference and expanded tokens."""
    own = F.filter(parts, lambda p: F.coalesce(p["kind"].isin(list(PLACEHOLDERS)), F.lit(False)))
    found = F.transform(own, lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p).alias("tokens")))
    return F.coalesce(found, F.array().cast("array<struct<kind:string,uri:string,tokens:bigint>>"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """``conv_id, formatted, loss, attachments, attachment_tokens``: ``loss`` holds start and length of each masked text in code points."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), flattened(F.col(parts_col)).alias("body"), attachments(F.col(parts_col)).alias("attached"))
    own = F.col("role") == ASSISTANT
    head = F.concat(F.when(own, "<s>").otherwise("[INST]"), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("%0A")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "body", F.when(own, "</s>").otherwise("[/INST]")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("before", before)
    span = F.when(own, F.struct((F.col("before") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")))
    turn = F.struct("at", "piece", span.alias("span"), "attached")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    attached = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("attachment_tokens"),
    )


def parsed(formatted: Column) -> Column:
    """Turns of a formatted conversation as an array of ``role, text, parts``.

    ``parts`` holds ``kind`` and ``text`` of the content: attachments have no text, neighbouring texts are one part.
    """
    pieces = F.filter(F.split(formatted, r"(?<=\[/INST\]|</s>)"), lambda p: p != "")
    marks = "|".join(PLACEHOLDERS)

    def part(piece: Column) -> Column:
        kind = F.lit("text")
        for name, mark in PLACEHOLDERS.items():
            kind = F.when(piece == mark, name).otherwise(kind)
        return F.struct(kind.alias("kind"), F.when(~piece.isin(list(PLACEHOLDERS.values())), unescaped(piece)).alias("text"))

    def turn(piece: Column) -> Column:
        opening = F.when(piece.startswith("<s>"), 3).otherwise(6)
        closing = F.when(piece.startswith("<s>"), 4).otherwise(7)
        line = F.locate("\n", piece)
        role = F.substring(piece, opening + 1, line - opening - 1)
        text = F.substring(piece, line + 1, F.length(piece) - line - closing)
        found = F.filter(F.split(text, f"(?=<(?:{marks})>)|(?<=<(?:{marks})>)"), lambda p: p != "")
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"), F.transform(found, part).alias("parts"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def formatted_digests(turns: DataFrame) -> DataFrame:
    """Write the formatted conversations, read them back and digest what the strings and masks hold."""
    written = materialize(format_conversations(turns), "conversations")
    seen = written.withColumn("turns", parsed(F.col("formatted"))).withColumn("masked", masked_text(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
