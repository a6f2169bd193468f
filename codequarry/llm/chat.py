"""Chat formatting by multi-party perspective rotation.

A conversation is rendered once for every participant: with that speaker as the assistant, all others as named users,
and a mask that leaves only the assistant's words and end marks to be learned. Turns of the system role belong to no
participant; they are rendered as such in every perspective.

DataFrame expressions only. A rendering is a table of segments, one a turn, with their places in the whole text, so
no conversation is ever gathered in one row or task. Places are prefix sums in two steps: over the totals of blocks of
turns, from lengths alone, and within blocks. Texts are shuffled once, by conversation and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns that share turn // BLOCK are summed up together.
BLOCK = 256
START, END, NOBODY = "<|im_start|>", "<|im_end|>", "unknown"
_OWN = ["conv_id", "turn", "role", "text"]


def header(perspective: Column, speaker: Column, system: str) -> Column:
    """What opens a turn: the system, the assistant, or a user by name."""
    who = F.when(speaker == system, F.lit("system")).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(START), who, F.lit("\n"))


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, perspective, position, turn, speaker, segment, start, end, mask_start, mask_end: one row for each turn
    in the perspective of each participant of its conversation.

    turns: conv_id, turn, role and text; further columns, whatever their names, are ignored. Segments in the order of
    position, from 0, make up the whole rendering; start and end are their places in it, mask_start and mask_end those
    of the part to learn (null in segments that aren't the assistant's), all in code points, ends exclusive. Turns are
    ordered by turn, speaker and text, nulls first; ties after that are equal rows and stay as many as they are. A null
    or empty role is the speaker `unknown`; null text is empty; a null conv_id is a conversation of its own. A
    conversation without any participant has no perspective and gives no row; an empty table gives an empty one. Long
    texts are never cut. A conversation that holds a third of all rows is summed up block by block.
    """
    speaker = F.when(F.coalesce(F.col("role"), F.lit("")) == "", F.lit(NOBODY)).otherwise(F.col("role"))
    # a struct equals another with null in the same place, so a null conversation or turn needs no care in joins
    key = F.struct(F.struct("conv_id").alias("conv"), F.floor(F.col("turn") / BLOCK).alias("block"))
    rows = turns.select(key.alias("key"), "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))

    # blocks in each perspective: how many turns, and how long
    tally = rows.groupBy("key", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    people = tally.select(F.col("key")["conv"].alias("conv"), F.col("speaker").alias("perspective")).where(F.col("perspective") != system).distinct()
    tally = tally.withColumn("conv", F.col("key")["conv"]).join(people, "conv")
    around = F.length(F.concat(header(F.col("perspective"), F.col("speaker"), system), F.lit(END + "\n")))
    blocks = tally.groupBy("key", "conv", "perspective").agg(F.sum("n").alias("n"), F.sum(F.col("chars") + F.col("n") * around).alias("size"))
    before = Window.partitionBy("conv", "perspective").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "perspective", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at0"))

    open_ = header(F.col("perspective"), F.col("speaker"), system)
    met = rows.join(blocks, "key").withColumn("segment", F.concat(open_, F.col("text"), F.lit(END + "\n")))
    met = met.withColumns({"size": F.length("segment").cast("long"), "opened": F.length(open_).cast("long")})
    # rows lie by key already, so this sorts within partitions and shuffles nothing
    so_far = Window.partitionBy("key", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    out = met.withColumns({"nth": F.row_number().over(so_far), "end": F.col("at0") + F.sum("size").over(so_far)})
    start = F.col("end") - F.col("size")
    learned = F.col("speaker") == F.col("perspective")
    return out.select(
        F.col("key")["conv"]["conv_id"].alias("conv_id"),
        "perspective",
        (F.col("n0") + F.col("nth") - 1).cast("long").alias("position"),
        "turn",
        "speaker",
        "segment",
        start.alias("start"),
        "end",
        F.when(learned, start + F.col("opened")).alias("mask_start"),
        F.when(learned, F.col("end") - 1).alias("mask_end"),
    )


#: The same over the table `conversations`, for DuckDB.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN '{NOBODY}' ELSE role END AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
    '{START}' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS opening
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), r AS (
  SELECT *, opening || text || '{END}' || chr(10) AS segment FROM s
), o AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS "end"
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn, speaker, segment, "end" - length(segment) AS start, "end",
  CASE WHEN speaker = perspective THEN "end" - length(segment) + length(opening) END AS mask_start,
  CASE WHEN speaker = perspective THEN "end" - 1 END AS mask_end
FROM o
"""
