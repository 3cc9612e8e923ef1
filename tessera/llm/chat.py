"""Chat formatting: logged snapshots that are prefixes of longer conversations collapse into those before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Turns that are numbered together, and turns of a rendered part.
BLOCK, PART = 512, 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_LAST = (1 << 63) - 1


def turns(spark: SparkSession, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct turns with pos (1, 2, ...), n (turns of the conversation) and the rolling hash up to the turn (x, y).

    The hash of a prefix is the exact sum of two 64-bit hashes of (position, role, text), so it rolls by prefix sums:
    first within blocks of a conversation, then over the blocks' sums.
    """
    given = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    numbered = given.withColumn("i", F.row_number().over(own))
    blocks = numbered.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"), F.sum("k").over(whole).alias("n"))
    placed = scratch.table(numbered.join(blocks, ["conv_id", "block"]).withColumn("pos", F.col("before") + F.col("i")).select("conv_id", "block", "pos", "n", "role", "text"))
    hashed = placed.withColumn("x", F.xxhash64("pos", "role", "text").cast("decimal(20,0)")).withColumn("y", F.xxhash64("text", "pos", "role", F.lit("y")).cast("decimal(20,0)"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hashed.groupBy("conv_id", "block").agg(F.sum("x").alias("bx"), F.sum("y").alias("by"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select("conv_id", "block", *(F.coalesce(F.sum(f"b{c}").over(ahead), zero).cast("decimal(38,0)").alias(f"a{c}") for c in "xy"))
    rolled = hashed.withColumns({c: F.sum(c).over(inside).cast("decimal(38,0)") for c in "xy"}).join(sums, ["conv_id", "block"])
    return scratch.table(rolled.select("conv_id", "pos", "n", "role", "text", *((F.col(c) + F.col(f"a{c}")).cast("decimal(38,0)").alias(c) for c in "xy")))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id of conversations that are no proper prefix of another; of equal ones the smallest id."""
    ends = rolled.filter("pos = n").groupBy("n", "x", "y").agg(F.min("conv_id").alias("conv_id"))
    prefixes = rolled.filter("pos < n").select(F.col("pos").alias("n"), "x", "y").distinct()
    return ends.join(prefixes, ["n", "x", "y"], "left_anti").select("conv_id")


def format_chats(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_parts, n_turns (of the conversation), n_chars and text.

    conversations has conv_id, turn, role and text; other columns are ignored.  Turns are ordered by turn (null last),
    role, text; rows alike in all four count once.  A null role or text is empty; rows without a conv_id belong to no
    conversation and are left out.  Parts hold PART turns, so that no conversation has to fit a task; all but very long
    ones have one part.  Marks of the format inside a text are broken up by spaces.  No rows, no result rows.
    """
    scratch = Scratch(spark, "chat")
    rolled = turns(spark, conversations, scratch)
    kept = rolled.join(maximal(rolled), "conv_id")
    clean = [F.regexp_replace(F.col(c), r"<\|im_(start|end)\|>", "<| im_$1 |>") for c in ("role", "text")]
    lines = kept.select("conv_id", F.expr(f"(pos - 1) div {PART}").alias("part"), "pos", "n", F.concat(F.lit(OPEN), clean[0], F.lit("\n"), clean[1], F.lit(CLOSE + "\n")).alias("line"))
    parts = lines.groupBy("conv_id", "part", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    parts = parts.select("conv_id", "part", F.expr(f"(n + {PART - 1}) div {PART}").alias("n_parts"), F.col("n").alias("n_turns"), text.alias("text"))
    return parts.select("conv_id", "part", "n_parts", "n_turns", F.length("text").cast("long").alias("n_chars"), "text")


ORACLE = f"""
WITH given AS (
  SELECT DISTINCT conv_id, coalesce(turn, {_LAST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM given
), ends AS (
  SELECT conv_id, n, list(struct_pack(role := role, text := text) ORDER BY pos) AS said FROM numbered GROUP BY conv_id, n
), firsts AS (
  SELECT min(conv_id) AS conv_id, n, said FROM ends GROUP BY n, said
), prefixes AS (
  SELECT DISTINCT k AS n, said[1:k] AS said FROM (SELECT said, n AS length, unnest(range(1, n)) AS k FROM firsts)
), maximal AS (
  SELECT conv_id FROM firsts ANTI JOIN prefixes USING (n, said)
)
SELECT conv_id, (pos - 1) // {PART} AS part, (n + {PART - 1}) // {PART} AS n_parts, n AS n_turns, CAST(length(string_agg(line, '' ORDER BY pos)) AS BIGINT) AS n_chars, string_agg(line, '' ORDER BY pos) AS text
FROM (
  SELECT conv_id, pos, n, '{OPEN}' || regexp_replace(role, '<\\|im_(start|end)\\|>', '<| im_\\1 |>', 'g') || chr(10) || regexp_replace(text, '<\\|im_(start|end)\\|>', '<| im_\\1 |>', 'g') || '{CLOSE}' || chr(10) AS line
  FROM numbered JOIN maximal USING (conv_id)
) GROUP BY conv_id, n, (pos - 1) // {PART}
"""
