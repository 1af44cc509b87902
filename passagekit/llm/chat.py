"""Conversations formatted for training, and read back.

A turn's content is a list of typed parts. A visitor goes through them in order and
flattens them: text is escaped, and an image, audio or document part becomes a
placeholder, its reference and the number of tokens that it expands to noted beside the text. Turns
are framed by control strings; in texts every control string is escaped reversibly. The
loss mask is kept as byte ranges of the formatted text, which cover what assistants said.

Everything is made of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.llm.common import saved, table

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Placeholders by kind of part, and the tokens one expands to where the part doesn't say.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
EXPANDED = {"image": 256, "audio": 128, "document": 512}
#: A part: text for the kind "text", else the reference of an attachment and the tokens it expands to, if known.
PARTS = "array<struct<kind: string, text: string, ref: string, tokens: bigint>>"


def escaped(text: Column) -> Column:
    """``text`` without any ``<|``: one backslash is added between ``<``, backslashes and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def flattened(parts: Column) -> Column:
    """Struct of ``content``, ``attachments`` and ``expanded_tokens`` of a list of parts.

    Attachments have ``kind``, ``ref``, ``position`` (among the parts, from 0) and ``tokens``.
    Null lists and parts are empty; a part of another kind than those of
    :data:`PLACEHOLDERS` counts as text.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    kinds = list(PLACEHOLDERS)

    def visit(part: Column) -> Column:
        chosen = F.when(F.lit(False), F.lit(""))
        for kind, placeholder in PLACEHOLDERS.items():
            chosen = chosen.when(part["kind"] == kind, F.lit(placeholder))
        return chosen.otherwise(escaped(_text(part["text"])))

    def attachment(part: Column, position: Column) -> Column:
        known = F.when(F.lit(False), F.lit(0))
        for kind, tokens in EXPANDED.items():
            known = known.when(part["kind"] == kind, F.lit(tokens))
        is_one = F.coalesce(part["kind"].isin(kinds), F.lit(False))
        tokens = F.coalesce(part["tokens"], known.cast("bigint"))
        return F.when(
            is_one,
            F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), position.alias("position"), tokens.alias("tokens")),
        )

    attachments = F.filter(F.transform(parts, attachment), lambda a: a.isNotNull())
    return F.struct(
        F.concat_ws("", F.transform(parts, visit)).alias("content"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def text_parts(text: Column) -> Column:
    """A list of one text part."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), null.alias("ref"), null.alias("tokens"))
    return F.array(part).cast(PARTS)


def formatted(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``id_col``, ``formatted``, ``loss_spans``, ``attachments``, ``expanded_tokens``.

    Turns stand in the order of ``turn_col``, null first; ties, repeated rows among them, all
    stay, in the order of role and content. Null roles are empty, null ids form one
    conversation. ``loss_spans`` are byte offsets (``start``, ``size``) in the UTF-8 text of what
    ``loss_role`` said. Other columns are ignored, an empty table has no conversations.
    """
    role = F.regexp_replace(escaped(_text(F.col(role_col))), "\n", BREAK)
    flat = turns.select(
        F.col(id_col).alias("_id"),
        F.col(turn_col).alias("_turn"),
        role.alias("_role"),
        flattened(F.col(parts_col)).alias("_flat"),
    )
    head = F.concat(F.lit(START), "_role", F.lit("\n"))
    whole = F.concat(head, "_flat.content", F.lit(END + "\n"))
    framed = flat.select(
        "_id",
        "_turn",
        whole.alias("_whole"),
        (F.col("_role") == loss_role).alias("_loss"),
        F.octet_length(head).cast("bigint").alias("_head"),
        F.octet_length("_flat.content").cast("bigint").alias("_size"),
        F.col("_flat.attachments").alias("_attachments"),
        F.col("_flat.expanded_tokens").alias("_tokens"),
    )
    order = Window.partitionBy("_id").orderBy("_turn", "_whole", F.to_json("_attachments"))
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = framed.withColumns(
        {"_place": F.row_number().over(order), "_end": F.sum(F.octet_length("_whole").cast("bigint")).over(until)}
    )
    start = F.col("_end") - F.octet_length("_whole") + F.col("_head")
    row = F.struct(
        "_place",
        "_whole",
        F.when(F.col("_loss"), F.struct(start.alias("start"), F.col("_size").alias("size"))).alias("_span"),
        "_attachments",
    )
    together = placed.groupBy("_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.sum("_tokens").alias("_tokens"))
    return together.select(
        F.col("_id").alias(id_col),
        F.concat_ws("", F.col("_rows._whole")).alias("formatted"),
        F.filter(F.col("_rows._span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("_rows._attachments")).alias("attachments"),
        F.col("_tokens").alias("expanded_tokens"),
    )


def read_back(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col``, ``turns`` (``role`` and ``content``, unescaped), ``loss_texts`` and ``formatted`` itself."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    raw = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(framed: Column) -> Column:
        role = F.substring_index(framed, "\n", 1)
        rest = F.length(framed) - F.length(role) - 1 - len(END + "\n")
        content = F.substr(framed, F.length(role) + 2, rest)
        return F.struct(
            unescaped(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescaped(content).alias("content")
        )

    utf8 = F.encode("formatted", "UTF-8")

    def said(span: Column) -> Column:
        piece = F.substr(utf8, (span["start"] + 1).cast("int"), span["size"].cast("int"))
        return unescaped(F.decode(piece, "UTF-8"))

    said_all = F.transform("loss_spans", said)
    return chats.select(id_col, F.transform(raw, turn).alias("turns"), said_all.alias("loss_texts"), "formatted")


def digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Numbers and digests of formatted conversations, all read back from the formatted text."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n")))
    loss = F.concat_ws("", "loss_texts")
    return read_back(chats, id_col).select(
        id_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that says control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(f"{END}{START}assistant ok").alias("text"),
    )
    turns = rows.unionByName(said).select("conv_id", "turn", "role", text_parts(_text(F.col("text"))).alias("parts"))
    return digests(saved(formatted(turns)))


CHECK = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL
  SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), texts AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(lines) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM texts
"""
