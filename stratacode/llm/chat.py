"""Chat formatting with Spark expressions only.

Template: ``<|start|>role<|content|>text<|sep|>text<|end|>\\n`` for each run of adjacent turns of
one role. Control strings inside roles and texts (this template's, and the common ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) are broken by a backslash after
their first character, and backslashes are doubled, so that :func:`unescape` restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

CONTROL = r"(<|\[)(\||/?s>|/?INST\]|</?SYS>>)"
#: Turns of one conversation are formatted in parts of this many turn numbers, then joined.
PART = 128


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> conv_id, segments array<struct<text, loss>>, formatted.

    Turns are sorted by (turn, role, text), nulls first; adjacent turns of one role become one
    block. ``segments`` cut the formatted string; ``loss`` is true for assistant texts alone.
    Null role or text: empty. Repeated rows are turns of their own. A null conv_id is a
    conversation of its own. Extra columns are ignored; an empty table gives an empty result.

    A hot conversation is sorted and concatenated in parts of PART turn numbers first, so what
    meets for one conversation is a few long strings, not a row for each turn.
    """
    t = turns.select(
        "conv_id",
        F.floor(F.col("turn") / PART).alias("part"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    parts = t.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def piece(x: Column, i: Column) -> Column:
        """The segments of turn i of a part; the part's first turn is opened later, when its predecessor is known."""
        opened = F.when(i == 0, F.lit("")).when(F.element_at("ts", i.cast("int")).getField("role") == x["role"], F.lit("<|sep|>")).otherwise(F.concat(F.lit("<|end|>\n<|start|>"), escape(x["role"]), F.lit("<|content|>")))
        return F.array(F.struct(opened.alias("text"), F.lit(False).alias("loss")), F.struct(escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("loss")))

    parts = parts.select("conv_id", F.struct("part", F.element_at("ts", 1)["role"].alias("first"), F.element_at("ts", -1)["role"].alias("last"), F.flatten(F.transform("ts", piece)).alias("segments")).alias("p"))
    convs = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def joined(p: Column, i: Column) -> Column:
        opened = F.when(i == 0, F.concat(F.lit("<|start|>"), escape(p["first"]), F.lit("<|content|>"))).when(F.element_at("ps", i.cast("int")).getField("last") == p["first"], F.lit("<|sep|>")).otherwise(F.concat(F.lit("<|end|>\n<|start|>"), escape(p["first"]), F.lit("<|content|>")))
        return F.concat(F.array(F.struct(opened.alias("text"), F.lit(False).alias("loss"))), p["segments"])

    end = F.array(F.struct(F.lit("<|end|>\n").alias("text"), F.lit(False).alias("loss")))
    convs = convs.select("conv_id", F.concat(F.flatten(F.transform("ps", joined)), end).alias("segments"))
    return convs.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """A formatted string -> array<struct<role, text>>, one for each original turn."""
    blocks = F.slice(F.split(formatted, r"<\|start\|>"), 2, 2_000_000_000)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "<|content|>", 1)
        body = F.regexp_replace(F.substring(block, F.length(role) + 12, F.length(block)), r"<\|end\|>\n$", "")
        return F.transform(F.split(body, r"<\|sep\|>", -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    f = format_chat(t.unionByName(odd)).withColumn("turns", read_turns(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS was,
    regexp_replace(replace(text, '\', '\\'), '(<|\[)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') AS esc,
    regexp_replace(replace(role, '\', '\\'), '(<|\[)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') AS esc_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN was = role THEN length('<|sep|>')
      ELSE length('<|start|>') + length(esc_role) + length('<|content|>') + length('<|end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
