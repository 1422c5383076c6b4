"""Chat formatting: the dialogue once for every participant, seen from that seat.

For each participant of a conversation the whole dialogue is rendered with that speaker
as the assistant, everybody else as a named user, and a mask that is on for the text of
the assistant alone.  The result has one row per (conversation, perspective, turn): the
rendered segment, where it lies in the rendered dialogue (code points, end exclusive),
and the span the loss mask covers.  Joining the segments of a perspective in order gives
the training text; no conversation is ever held by one task.

Scale: all rows are numbered in order of conversation and turn (by ranges), and blocks are
``BLOCK`` numbers wide.  Segment lengths are summed per (conversation, block, speaker) first;
offsets of blocks come from that aggregate, and only the turns of one block meet in a
window.  A conversation with a third of all rows, or one whose turns are all null or equal,
is spread over its blocks.

Defined cases: a null or empty text renders as an empty message; a null role is the
speaker ``?``; a null turn comes first; equal turns are ordered by role and text, and
repeated rows are all kept; a null conversation id is a conversation of its own; ids may be
of any type.  Roles in ``CONTEXT`` (``system``) set the scene: rendered as such, never as a
perspective.  Control marks in names and texts are escaped (``<|`` as ``<\\|``, ``|>`` as
``|\\>``), and line ends in names are spaces, so nobody can write another's message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from umbra.llm.common import table
from umbra.operators.numbering import numbered

BLOCK = 1024
ORDER = ["no_conv", "conv", "at", "speaker", "body"]
CONTEXT = ("system",)


def escaped(text: Column) -> Column:
    """Without control marks: names and texts can't end a message or begin one."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def perspectives(turns: DataFrame, block: int = BLOCK, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id",
        F.coalesce("turn", F.lit(-(2**62))).alias("at"), "turn",
        F.coalesce("role", F.lit("?")).alias("speaker"), escaped(F.coalesce("text", F.lit(""))).alias("body"),
    )
    rows = numbered(rows, ORDER, "n").withColumn("block", F.floor(F.col("n") / block))
    scene = F.col("speaker").isin(*context)
    name = F.translate(escaped(F.col("speaker")), "\r\n", "  ")
    plain = F.when(scene, F.concat(F.lit("<|"), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    own = F.lit("<|assistant|>\n")
    close = F.lit("\n<|end|>\n")
    rows = rows.withColumn("n_body", F.length("body")).withColumn("n_plain", F.length(plain)).withColumn("scene", scene)
    summed = rows.groupBy("no_conv", "conv", "block", "speaker", "scene", "n_plain").agg(F.sum("n_body").alias("n_body"), F.count("*").alias("n"))
    seats = summed.where(~F.col("scene")).select("no_conv", "conv", F.col("speaker").alias("assistant")).distinct()
    mine = (F.col("speaker") == F.col("assistant")) & ~F.col("scene")
    head = F.when(mine, F.length(own)).otherwise(F.col("n_plain"))
    before = W.partitionBy("no_conv", "conv", "assistant").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        summed.join(seats, ["no_conv", "conv"])
        .groupBy("no_conv", "conv", "assistant", "block").agg(F.sum(F.col("n_body") + F.col("n") * (head + F.length(close))).alias("length"))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .drop("length")
    )
    inside = W.partitionBy("no_conv", "conv", "assistant", "block").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(offsets, ["no_conv", "conv", "block"])
        .withColumn("head", F.when(mine, own).otherwise(plain))
        .withColumn("segment", F.concat("head", "body", close))
        .withColumn("start", F.col("offset") + F.coalesce(F.sum(F.length("segment")).over(inside), F.lit(0)))
        .select(
            "conv_id", "assistant", "turn", F.col("speaker").alias("speaker"), mine.alias("is_assistant"), "segment", "start",
            (F.col("start") + F.length("segment")).alias("end"),
            F.when(mine, F.col("start") + F.length("head")).alias("mask_start"),
            F.when(mine, F.col("start") + F.length("head") + F.length("body")).alias("mask_end"),
        )
    )


def op7_chat(spark, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(turn, -4611686018427387904) AS pos, coalesce(role, '?') AS speaker,
         translate(replace(replace(coalesce(role, '?'), '<|', '<\|'), '|>', '|\>'), chr(13) || chr(10), '  ') AS name,
         replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS body FROM conversations),
seats AS (SELECT DISTINCT conv_id, speaker AS assistant FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.*, assistant, speaker = assistant AS mine,
         CASE WHEN speaker = assistant THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || name || '|>' || chr(10) END AS head
  FROM t JOIN seats ON t.conv_id IS NOT DISTINCT FROM seats.conv_id),
r AS (SELECT *, head || body || chr(10) || '<|end|>' || chr(10) AS segment FROM s),
p AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, assistant ORDER BY pos, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r)
SELECT conv_id, assistant, turn, speaker, mine AS is_assistant, segment, start, start + length(segment) AS "end",
       CASE WHEN mine THEN start + length(head) END AS mask_start, CASE WHEN mine THEN start + length(head) + length(body) END AS mask_end
FROM p
"""
