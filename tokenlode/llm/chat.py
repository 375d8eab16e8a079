"""Chat formatting after collapsing cumulative snapshots.

Chats are often logged after each turn, so a log holds the same conversation
many times, each time some turns longer. Every conversation gets a rolling
hash of its turns; one whose last hash is the hash of a proper prefix of
another is a snapshot of it. An anti-join leaves the maximal conversations,
of equal ones the one with the least id, and these are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns), the turns in order and each once."""
    d = turns.select(
        named(turns, "conv_id").alias("conv_id"), named(turns, "turn").alias("turn"),
        F.coalesce(F.lower(F.trim(named(turns, "role"))), F.lit("unknown")).alias("role"), F.coalesce(named(turns, "text"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    return d.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")))).alias("turns"))


def maximal(convs: DataFrame) -> DataFrame:
    """conv_id of the conversations that are a proper prefix of no other, one of each."""
    step = lambda h, t: F.md5(F.concat(h, F.md5(F.concat(t["role"], F.lit("\n"), t["text"]))))
    rolled = F.aggregate(
        "turns", F.struct(F.lit("").alias("h"), F.array().cast("array<string>").alias("all")), lambda a, t: F.struct(step(a["h"], t).alias("h"), F.array_append(a["all"], a["h"]).alias("all"))
    )
    hashed = convs.select("conv_id", rolled.alias("r"))
    full = hashed.select(F.col("r.h").alias("h"), "conv_id").groupBy("h").agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.select(F.explode("r.all").alias("h")).where("h <> ''").distinct()
    return full.join(prefixes, "h", "left_anti").select("conv_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations.

    A turn is rendered as <|im_start|>role, a line break, its text, <|im_end|>
    and a line break; '<|' in a role or text becomes '< |', so that no text can
    open or close a turn. Roles are trimmed and put in lower case. Turns go by
    turn (nulls last), then role and text; rows alike in all four count once.
    Prefixes compare roles and texts, not turn numbers. A null role is
    'unknown', a null text the empty one; rows without conv_id belong to no
    conversation and go. An empty table gives an empty one. Other columns
    don't matter.
    """
    convs = conversations(turns)
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    text = F.transform("turns", lambda t: F.concat(F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit("<|im_end|>\n")))
    return convs.join(maximal(convs), "conv_id", "left_semi").select("conv_id", F.size("turns").alias("n_turns"), F.array_join(text, "").alias("rendered"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(lower(trim(role)), 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), p AS (
  SELECT conv_id, k, n, string_agg(md5(role || chr(10) || text), '') OVER (PARTITION BY conv_id ORDER BY k) AS h FROM n
), m AS (
  SELECT min(conv_id) AS conv_id FROM p WHERE k = n AND h NOT IN (SELECT h FROM p WHERE k < n) GROUP BY h
)
SELECT conv_id, max(n)::INT AS n_turns,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM n WHERE conv_id IN (SELECT conv_id FROM m) GROUP BY conv_id
"""
