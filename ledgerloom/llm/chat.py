"""Operator 9: chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent turns of one role are
merged into blocks by array functions; the blocks are concatenated to

    <|role:ROLE|>TEXT<|next|>TEXT<|end|>  (``<|next|>`` stands between merged turns)

Inside roles and texts a backslash is doubled, ``<|`` becomes ``<\\|`` and ``|>`` becomes
``|\\>``, so no text can produce a mark and :func:`parse_chat` restores every turn. ``loss_spans``
holds the character spans (start from 0, length) of the assistant texts; marks are outside.

Defined cases: a null role or text is empty; turns sort by (turn, role, text), null turns first;
repeated rows are repeated turns; rows of a null conv_id form one conversation; an empty table
gives no rows; other columns are ignored. One conversation is one output string, so its turns meet
in one row; partial lists are built before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NEXT, END, ROLE, CLOSE = "<|next|>", "<|end|>", "<|role:", "|>"
#: The conversation that the contract adds: its texts hold another template's control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit("<|"), F.lit("<\\|"))
    return F.replace(x, F.lit("|>"), F.lit("|\\>"))


def unescape(x: Column) -> Column:
    x = F.replace(x, F.lit("|\\>"), F.lit("|>"))
    x = F.replace(x, F.lit("<\\|"), F.lit("<|"))
    return F.replace(x, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans)."""
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    starts = F.filter(
        F.transform("turns", lambda x, i: F.when((i == 0) | (x["role"] != F.get("turns", i - 1)["role"]), i)),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: t["text"]
            ).alias("texts"),
        ),
    )
    rows = rows.select("conv_id", blocks.alias("blocks"))
    # each block as segments: its head, its texts with marks between them, its end
    segments = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(F.concat(F.lit(ROLE), escape(b["role"]), F.lit(CLOSE)).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            F.struct(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                            F.struct(t.alias("s"), (b["role"] == loss_role).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    rows = rows.select("conv_id", segments.alias("segments"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["s"])).cast("long").alias("at"),
            F.when(
                s["loss"],
                F.array_append(
                    a["spans"], F.struct(a["at"].alias("start"), F.length(s["s"]).cast("long").alias("length"))
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    text = F.array_join(F.transform("segments", lambda s: s["s"]), "")
    return rows.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate(CLOSE, b) + len(CLOSE)), r"<\|next\|>", -1),
                lambda t: F.struct(
                    unescape(F.substr(b, F.lit(len(ROLE) + 1), F.locate(CLOSE, b) - len(ROLE) - 1)).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string")
    chats = format_chats(turns.unionByName(planted))
    back = chats.select(
        "conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS body,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN before = role THEN 8 ELSE 7 + length(head) + 2 + 7 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
