"""Chat formatting of maximal logged conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, pos, role, text, n_turns) of conversations that aren't a prefix of a longer one.

    A log that stores the conversation anew after every turn holds each snapshot as a conversation. A rolling hash of
    the turns so far (128 bits, from position, role and text) names each prefix; a conversation whose last hash is a
    proper prefix of any other goes, and of equal ones the smallest conv_id stays. Turns count in order of turn, role
    and text (nulls first; null role or text counts as empty); fully repeated rows count once; rows without conv_id
    belong to no conversation and are left out. Texts are shuffled once, to their conversation, and used whole, however
    long; across conversations only hashes travel, aggregated first, so copies in any number meet as one row a task.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.repartition("conv_id").distinct()  # repeated rows lie in one conversation, so this needs no shuffle of its own
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = clean.withColumn("pos", F.row_number().over(w)).withColumn("n_turns", F.count("*").over(W.partitionBy("conv_id")))
    rolled = placed.withColumn("h1", F.bit_xor(F.xxhash64("pos", "role", "text")).over(w)).withColumn("h2", F.bit_xor(F.xxhash64(F.lit("second"), "text", "role", "pos")).over(w))
    key = ["h1", "h2", "pos"]
    longer = rolled.where("pos < n_turns").select(*key).distinct()
    last = rolled.where("pos = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id")).join(longer, key, "left_anti")
    return placed.join(last.select("conv_id"), "conv_id", "left_semi")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): turns between <|im_start|> and <|im_end|>; a "<|" inside a turn is written "< |".

    One row per conversation; null role or text counts as empty. Other columns are ignored; an empty table gives no rows.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    one = F.concat(F.lit("<|im_start|>"), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit("<|im_end|>\n"))
    parts = turns.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("one")))).alias("parts"))
    return parts.select("conv_id", "n_turns", F.array_join(F.transform("parts", lambda p: p["one"]), "").alias("text"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '') OVER w AS so_far
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT min(conv_id) AS conv_id, n_turns, so_far FROM p WHERE pos = n_turns GROUP BY n_turns, so_far)
SELECT conv_id, n_turns, so_far AS text FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = f.n_turns AND p.so_far = f.so_far)
"""
