"""Perspective rotation of multi-party dialogues, in DataFrame operations.

For every participant of a conversation the dialogue is rendered with that speaker
as the assistant and all others as named users; system turns stay system turns.  A
turn of a perspective is one row: its segment of the rendered dialogue, the
segment's character range in it, and the range to train on, which is the content
and end mark of the assistant's turns.  The segments of a perspective, in order of
``position``, are the dialogue.

A conversation can be of any length, so none is gathered into one row or task.
Turns are sorted by ranges of (conversation, number, speaker, text); a range's part of
a conversation is a block, and however many turns share a number or have none, they
fall into several.  Positions and offsets are the sums over earlier blocks, one row
each, plus those within the block.

Defined cases.  A null text is empty.  A null or blank role is the speaker
"unknown".  A null turn comes after all others.  Turns with equal numbers (ties) are
ordered by role and text; equal rows are separate turns.  Rows with a null
conversation id are one conversation, apart from that of the empty id.  A conversation
of system turns alone has no perspective.  ``<|`` in a text or role is written ``< |``,
so that only real marks look like marks.  An empty table gives an empty one.  Texts of
any length are rendered whole.  Only the four columns named are read, so others may
have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

END = "<|end|>\n"


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system"
) -> DataFrame:
    """``(conv_id, perspective, position, turn, role, name, segment, start, end, target_start, target_end)``."""
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    speaker = F.when(F.trim(F.coalesce(F.col(role_col), F.lit(""))) == "", F.lit("unknown")).otherwise(F.col(role_col))
    base = turns.select(
        F.coalesce(F.concat(F.lit("id "), F.col(conv_col).cast("string")), F.lit("null")).alias("k"),
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        clean(speaker).alias("speaker"),
        clean(F.coalesce(F.col(text_col), F.lit(""))).alias("content"),
    )
    base = base.withColumn("length", F.char_length("content").cast("long"))
    # the number of a row's range: ranges are in order, and a stored one doesn't change
    order = [F.asc_nulls_last("turn"), F.col("speaker"), F.col("content")]
    numbered = base.withColumn("n", F.monotonically_increasing_id())  # parts equal rows
    base = stored(numbered.repartitionByRange("k", *order, "n").withColumn("block", F.spark_partition_id()).drop("n"), "turns")
    role = F.when(F.col("speaker") == system, F.lit(system)).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(F.col("role") == "user", F.col("speaker"))
    head = F.concat(F.lit("<|"), F.col("role"), F.coalesce(F.concat(F.lit(" "), F.col("name")), F.lit("")), F.lit("|>\n"))
    people = base.where(F.col("speaker") != system).select("k", F.col("speaker").alias("perspective")).distinct()
    headed = lambda df: df.join(people, "k").withColumn("role", role).withColumn("name", name).withColumn("head", head)
    keys = ["k", "perspective", "block"]
    before = Window.partitionBy("k", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # sums of each block follow from those of its speakers, without the texts
    sums = headed(base.groupBy("k", "block", "speaker").agg(F.count("*").alias("turns"), F.sum("length").alias("lengths")))
    chars = F.sum(F.col("lengths") + F.col("turns") * (F.char_length("head") + len(END)))
    blocks = sums.groupBy(*keys).agg(F.sum("turns").alias("n"), chars.alias("chars"))
    blocks = blocks.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c0"))
    rows = headed(base).withColumn("size", F.char_length("head") + F.col("length") + len(END))
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("i", F.row_number().over(inside)).withColumn("c", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(blocks, keys).withColumn("segment", F.concat("head", "content", F.lit(END)))
    start = F.col("c0") + F.col("c") - F.col("size")
    own = F.col("role") == "assistant"
    return rows.select(
        "conv_id",
        "perspective",
        (F.col("n0") + F.col("i") - 1).cast("long").alias("position"),
        "turn",
        "role",
        "name",
        "segment",
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        F.when(own, start + F.char_length("head")).alias("target_start"),
        F.when(own, start + F.col("size") - 1).alias("target_end"),  # the end mark without its line end
    )


#: The same for DuckDB, over a view ``conversations``.
SQL = f"""
WITH base AS (
  SELECT conv_id, turn, replace(CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END, '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
both_ AS (
  SELECT b.*, p.perspective,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM base b JOIN people p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ' ' || speaker ELSE '' END || '|>' || chr(10) AS head FROM both_),
sized AS (SELECT *, head || content || '<|end|>' || chr(10) AS segment, length(head || content || '<|end|>' || chr(10)) AS size FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, content))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, name, segment,
       CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
       CAST(CASE WHEN role = 'assistant' THEN stop - size + length(head) END AS BIGINT) AS target_start,
       CAST(CASE WHEN role = 'assistant' THEN stop - 1 END AS BIGINT) AS target_end
FROM placed
"""
