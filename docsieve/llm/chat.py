"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an array of parts ``struct<kind string, text string, ref string, tokens long>`` where kind is text, image,
audio or document. A visitor flattens the parts in order: neighbouring text parts are one text, which is escaped as a
whole (parts by themselves could join to a control string); any other part gives a placeholder ``<|kind|>`` whose
reference and expanded token count go to ``attachments``. Turns are marked

    <|turn|>ROLE<|says|>CONTENT<|end|>

and control strings inside roles and texts are escaped by one more backslash behind their first character. The escape
maps a run of k backslashes to k+1, so it is one-to-one and can be undone; an escaped text holds no ``<|``, so that what
looks like a placeholder is one.

A conversation is formatted in blocks of ``block`` turns, so that no task has to hold a whole long conversation;
the formatted conversation is its blocks in order. Spans of the loss mask count code points inside the block.

Nulls: a null text, role or part counts as empty, null parts as none; a part of another kind counts as text; rows with a
null turn come first, in a block of their own; a null id is a conversation of its own. Repeated rows stay, ties of turn go
by role and text. An empty table gives no rows. Only the four columns named are read; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
ATTACHMENTS = ("image", "audio", "document")
#: What follows the first character of a control string, of this template and of other common ones.
_TAIL = r"(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
ESCAPE = (r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def text_parts(text: Column) -> Column:
    """A plain text as a message of one text part."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("long").alias("tokens"),
    )
    return F.array(part)


def line_parts(text: Column) -> Column:
    """A plain text as a message of one text part a line, each with the line break that ends it."""
    lines = F.split(F.coalesce(text, F.lit("")), r"(?<=\n)")
    part = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    return F.transform(lines, part)


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*ATTACHMENTS), F.lit(False))


def flattened(parts: Column) -> Column:
    """The visitor: parts to content. Between two attachments (or an end) all text parts are joined, then escaped."""
    size = F.when(parts.isNull(), 0).otherwise(F.size(parts))
    at = F.filter(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: is_attachment(F.element_at(parts, i)))
    edges = F.concat(F.array(F.lit(0)), at, F.array(size + 1))
    text = lambda a, z: F.array_join(
        F.transform(F.slice(parts, a + 1, z - a - 1), lambda p: F.coalesce(p["text"], F.lit(""))), ""
    )
    mark = lambda z: F.when(z <= size, F.concat(F.lit("<|"), F.get(parts, z - 1)["kind"], F.lit("|>"))).otherwise("")
    spans = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, z: F.concat(escaped(text(a, z)), mark(z)))
    return F.when(size > 0, F.array_join(spans, "")).otherwise("")


def format_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    trained_roles: tuple[str, ...] = ("assistant",),
    block: int = 64,
) -> DataFrame:
    """Rows ``conv_id, block, n_turns, formatted, loss array<struct<start,length>>, attachments array<...>``.

    ``attachments`` lists (turn, kind, ref, tokens) in placeholder order; ``start`` counts from 0.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    content = flattened(F.col(parts_col))
    rows = df.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn_col) / block), F.lit(-(1 << 63))).alias("block"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            content.alias("content"),
            F.transform(
                F.filter(F.col(parts_col), is_attachment),
                lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
            ).alias("attached"),
        ).alias("m"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    head = lambda m: F.concat(F.lit(TURN), escaped(m["role"]), F.lit(SAYS))
    blocks = blocks.withColumn(
        "turns",
        F.transform(
            "ms",
            lambda m: F.struct(
                head(m).alias("head"),
                m["content"].alias("content"),
                m["role"].isin(*trained_roles).alias("trained"),
                F.length(head(m)).cast("long").alias("h"),
                F.length(m["content"]).cast("long").alias("c"),
            ),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["h"] + t["c"] + len(END)).alias("at"),
        F.when(
            t["trained"],
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["h"]).alias("start"), t["c"].alias("length")))),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    return blocks.select(
        "conv_id",
        "block",
        F.size("ms").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda acc: acc["spans"]).alias("loss"),
        F.flatten(
            F.transform(
                "ms",
                lambda m: F.transform(
                    F.coalesce(m["attached"], F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>")),
                    lambda a: F.struct(m["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
                ),
            )
        ).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of formatted text: ``array<struct<role, text>>``, unescaped; placeholders stay in the text."""
    marks = F.array_remove(F.split(formatted, r"<\|turn\|>"), "")  # a turn is never empty; what stands before the first is
    return F.transform(
        marks,
        lambda t: F.struct(
            unescaped(F.substring_index(t, SAYS, 1)).alias("role"),
            unescaped(
                F.substring_index(F.substring(t, F.locate(SAYS, t) + len(SAYS), F.length(t)), END, 1)
            ).alias("text"),
        ),
    )


def read_parts(content: Column) -> Column:
    """Content as it stands between its marks, back to ``array<struct<kind, text>>``: an attachment has a null text, and
    text parts that stood side by side are one."""
    pieces = F.split(F.regexp_replace(content, r"(<\|(?:image|audio|document)\|>)", "\n<|part|>$1\n<|part|>"), r"\n<\|part\|>")
    kind = lambda p: F.regexp_extract(p, r"^<\|(image|audio|document)\|>$", 1)
    parts = F.transform(pieces, lambda p: F.struct(F.when(kind(p) == "", "text").otherwise(kind(p)).alias("kind"), F.when(kind(p) == "", unescaped(p)).alias("text")))
    return F.filter(parts, lambda p: (p["kind"] != "text") | (p["text"] != ""))


def contents(formatted: Column) -> Column:
    """The contents of the turns of formatted text, still escaped."""
    marks = F.array_remove(F.split(formatted, r"<\|turn\|>"), "")
    return F.transform(marks, lambda t: F.substring_index(F.substring(t, F.locate(SAYS, t) + len(SAYS), F.length(t)), END, 1))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def digests(blocks: DataFrame) -> DataFrame:
    """One row a conversation, all read back from the blocks' formatted text."""
    read = blocks.select(
        "conv_id",
        F.struct(
            "block",
            F.array_join(
                F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).alias("turns"),
            read_loss(F.col("formatted"), F.col("loss")).alias("loss"),
        ).alias("b"),
        F.size(read_turns(F.col("formatted"))).cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.size("attachments").cast("long").alias("attached"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["tokens"], F.lit(0))).alias("expanded"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("b")).alias("bs"), F.sum("chars").alias("formatted_chars"),
        F.sum("attached").alias("n_attachments"), F.sum("expanded").alias("attached_tokens"),
    )
    joined = whole.withColumn("loss", F.array_join("bs.loss", ""))
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("bs.turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
        "attached_tokens",
    )
