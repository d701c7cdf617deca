"""Multi-party perspective rotation of conversations (operator 10), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Turns of a conversation whose lengths are summed in one window; longer ones are summed by blocks.
BLOCK = 64


def _clean(text: Column) -> Column:
    """Text cannot forge a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system_role: str = "system") -> DataFrame:
    """For every speaker of every conversation, the dialogue seen with that speaker as assistant.

    One row per (conversation, perspective, turn): the rendered segment, its place in the rendered
    dialogue and the trained span [mask_start, mask_end) within it, which is the text and end marker
    of the assistant's own turns and null elsewhere. Others are users with their names; system turns
    are the same in every perspective and have none of their own.

    Turns are in the order of turn (null first), role and text; repeated rows are repeated turns. A
    null role is the speaker "unknown", a null text an empty turn, a null conversation one of its
    own. A conversation of system turns alone has no perspective and gives no rows. Places are summed
    per block of turns and over blocks, so a conversation with a large part of all rows is not summed
    in one window, nor are its turns without numbers unless they say the same; it is joined with its speakers by a join that Spark splits when skewed."""
    own = turns.select(
        turns[conv].alias("conv_id"),
        turns[turn].cast("bigint").alias("turn"),
        F.coalesce(turns[role], F.lit("unknown")).alias("role"),
        _clean(turns[text]).alias("said"),
    )
    speakers = own.where(F.col("role") != system_role).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    seen = own.join(speakers, own.conv_id.eqNullSafe(speakers.c)).drop("c")
    trained = F.col("role") == F.col("perspective")
    head = F.when(trained, "<|assistant|>\n").when(F.col("role") == system_role, "<|system|>\n").otherwise(F.concat(F.lit("<|user:"), _clean(F.col("role")), F.lit("|>\n")))
    seen = seen.withColumn("head", head).withColumn("segment", F.concat("head", "said", F.lit("<|end|>\n")))
    key = ["conv_id", "perspective"]
    # Null turns are first in order: their blocks come before block 0 and are cut further, in the same
    # order, by role and the first characters said.
    no_turn = F.col("turn").isNull()
    part = lambda c: F.when(no_turn, c).otherwise("")
    said = F.substring(F.concat("said", F.lit("<|end|>")), 1, 3)
    block = F.struct(F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).alias("b"), part(F.col("role")).alias("role"), part(said).alias("said"))
    seen = seen.withColumn("n", F.char_length("segment").cast("bigint")).withColumn("block", block)
    inside = Window.partitionBy(*key, "block").orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, -1)
    rank = Window.partitionBy(*key, "block").orderBy("turn", "role", "segment")
    blocks = seen.groupBy(*key, "block").agg(F.sum("n").alias("bn"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"))
    placed = seen.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("k", F.row_number().over(rank))
    placed = placed.join(blocks, placed.conv_id.eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("n0") + F.col("inner")
    masked = F.col("role") == F.col("perspective")
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("r0") + F.col("k") - 1).alias("position"),
        "turn",
        "role",
        "segment",
        start.alias("seg_start"),
        (start + F.col("n")).alias("seg_end"),
        F.when(masked, start + F.char_length("head")).alias("mask_start"),
        F.when(masked, start + F.col("n") - 1).alias("mask_end"),
    )


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH own AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM own WHERE role <> 'system'),
seen AS (
  SELECT o.conv_id, perspective, turn, role, said,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user:' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head
  FROM own o JOIN speakers s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
cut AS (SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM seen),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS seg_end
  FROM cut WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, segment ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, role, segment, seg_end - length(segment) AS seg_start, seg_end,
  CASE WHEN role = perspective THEN seg_end - length(segment) + length(head) END AS mask_start,
  CASE WHEN role = perspective THEN seg_end - 1 END AS mask_end
FROM placed
"""
