"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is ``<|turn|>`` role ``<|text|>`` body ``<|end|>``.  A body is a turn's parts, flattened in
order: text as it is, escaped; an image, audio or document part as its placeholder.  The
attachments of a conversation are listed in the order of their placeholders, with their references
and the tokens they expand to.

Escaping: a backslash is doubled, and a backslash goes behind the first character of every control
string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``).  So no text
holds a marker, and dropping one backslash of each pair it begins gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
IMAGE_PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def part_tokens(part: Column) -> Column:
    """Tokens that a part expands to: image patches, audio frames, pages; null for text."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_PATCH)
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * DOCUMENT_TOKENS_A_PAGE)
        .cast("long")
    )


def visit(part: Column) -> Column:
    """What a part puts into the body; parts of unknown kinds are text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def format_chats(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens) per conversation.

    ``turns`` has conv_id, turn, role and text; an array column ``parts`` of PART structs, if there
    is one, is used instead of a text wherever it isn't null; a text alone is one text part.  Turns are
    ordered by turn, nulls first; equal ones by role, text and body, as they were before escaping.  Null texts and roles are empty.  Rows with a null conv_id
    are one conversation.  ``loss_spans`` are (start, length) in code points, from 1, of the bodies
    of the roles to learn from.  Repeated rows all count.  Other columns aren't looked at.  An empty
    table gives an empty one.

    A conversation is one output string, so its turns meet in one task; nothing else is gathered.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = lambda name: F.lit(None).alias(name)
    alone = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *map(none, ("ref", "width", "height", "seconds", "pages")))).cast(f"array<{PART}>")
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), alone) if "parts" in turns.columns else alone
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    d = turns.select("conv_id", "turn", role.alias("said_by"), text.alias("said"), parts.alias("parts"))
    attached = F.transform(F.filter("parts", lambda p: p["kind"].isin(*PLACEHOLDERS)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    d = d.select("conv_id", "turn", "said_by", "said", escape(F.col("said_by")).alias("role"), F.col("said_by").isin(*learn_from).alias("learn"),
        F.concat_ws("", F.transform("parts", visit)).alias("body"), attached.alias("attached"))
    head = F.concat(F.lit(TURN), "role", F.lit(TEXT))
    d = d.select("conv_id", "turn", "said_by", "said", "learn", "attached", F.concat(head, "body", F.lit(END)).alias("piece"),
        F.length(head).alias("head"), F.length("body").alias("body_chars"), "body")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "said_by", "said", "body")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("place", F.row_number().over(order)).withColumn("start", (before + F.col("head") + 1).cast("int"))
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "learn", "start", "body_chars", "attached"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["body_chars"].alias("length")))
    d = d.select("conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"), spans.alias("loss_spans"), F.flatten("turns.attached").alias("attachments"))
    return d.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    inner = lambda p: F.substring_index(p, END, 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(inner(p), TEXT, 1)).alias("role"), unescape(F.substring_index(inner(p),
        TEXT, -1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
