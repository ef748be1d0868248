"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions only.

Loggers often store a conversation again after every turn. The hash of a prefix is the
exclusive-or of the hashes of (position, role, text) of its turns, so one window rolls it
over all turns. A conversation whose whole hash is a proper prefix of a longer one goes
(anti-join), of equal ones the smallest id stays, and only those left are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "k", "role", "text")


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, k, role, text) with ``k`` from 1; ties of a turn number are ordered by role and text."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return t.select("conv_id", F.row_number().over(order).alias("k"), "role", "text", "turn")


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_collapsed, chat.

    ``n_collapsed`` counts the copies with a larger id that it stands for (prefixes of a longer
    conversation are not counted, as they may belong to several). Null roles and texts count as
    empty, null turn numbers come first, rows with a null conv_id form one conversation, repeated
    rows are turns of their own; an empty table gives no rows; further columns are ignored.
    """
    rolling = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    prefix = numbered(turns).select(
        "conv_id", "k", F.bit_xor(_hash(1)).over(rolling).alias("a"), F.bit_xor(_hash(2)).over(rolling).alias("b"),
        F.max("k").over(Window.partitionBy("conv_id")).alias("n"),
    )
    whole = prefix.where("k = n").groupBy("n", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("first"), (F.count("*") - 1).alias("n_collapsed"))
    inner = prefix.where("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    kept = whole.join(inner, ["n", "a", "b"], "left_anti").select(F.col("first.conv_id").alias("kept_id"), F.col("n").alias("n_turns"), "n_collapsed")
    left = numbered(turns).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    line = F.struct("k", render(F.col("role"), F.col("text")).alias("line"))
    chat = left.groupBy("conv_id", "n_turns", "n_collapsed").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return chat.select("conv_id", "n_turns", "n_collapsed", F.array_join("lines.line", "").alias("chat"))


#: DuckDB: prefixes compared as text.
ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations),
p AS (
  SELECT conv_id, k, max(k) OVER (PARTITION BY conv_id) AS n,
         string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY k) AS h FROM t),
w AS (SELECT n, h, min(conv_id) AS conv_id, count(*) - 1 AS n_collapsed FROM p WHERE k = n GROUP BY n, h),
i AS (SELECT DISTINCT h FROM p WHERE k < n),
kept AS (SELECT * FROM w WHERE h NOT IN (SELECT h FROM i))
SELECT t.conv_id, CAST(kept.n AS INTEGER) AS n_turns, kept.n_collapsed AS n_collapsed,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS chat
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL
"""
