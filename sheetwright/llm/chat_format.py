"""Chat formatting: logged snapshots of growing conversations collapse, the rest is rendered.

A conversation's turns give a chain of hashes, one for each prefix of turns. A
conversation whose last hash is among the proper prefixes of a longer one is a
snapshot of it and goes, by an anti-join. Of conversations with the same turns
the one with the smallest conv_id stays. What remains is rendered.

Prefix hashes are made distinct before they are dealt out, and copies are
reduced to one first, so a first turn or a conversation that a third of all
rows share is one row from each task.

Edge cases: a null role counts as ``unknown``, a null text as empty; turns are
ordered by turn (nulls first), then role, then text; rows repeated whole count
once; rows with a null conv_id form one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands around a turn.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, in order."""
    given = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))


def prefix_hashes(column: str = "turns"):
    """The hash of every prefix: that of the prefix before, the role and the text."""
    start = F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<string>)").alias("all"))

    def step(acc, t):
        here = F.sha2(F.concat(acc["last"], F.lit("|"), F.length(t["role"]).cast("string"), F.lit("|"), t["role"], t["text"]), 256)
        return F.struct(here.alias("last"), F.concat(acc["all"], F.array(here)).alias("all"))

    return F.aggregate(F.col(column), start, step)["all"]


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, turns and copies (conversations with the same turns) of the maximal conversations."""
    chained = turns(conversations).withColumn("hashes", prefix_hashes())
    whole = chained.select("conv_id", F.element_at("hashes", -1).alias("whole"))
    first = whole.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), F.max(F.col("conv_id").isNull()).alias("no_id"))
    prefixes = chained.where(F.size("hashes") > 1).select(F.explode(F.expr("slice(hashes, 1, size(hashes) - 1)")).alias("whole")).distinct()
    kept = first.join(prefixes, "whole", "left_anti").select(F.col("conv_id").alias("kept_id"), "n_copies")
    return chained.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", "turns", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of the maximal conversations."""
    piece = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))
    return collapse(conversations).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("turns", piece), "").alias("rendered"))


ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), ordered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), prefixes AS (
  SELECT conv_id, k, n, string_agg(md5(length(role) || '|' || role || text), '') OVER (PARTITION BY conv_id ORDER BY k) AS chain
  FROM ordered
), whole AS (
  SELECT chain, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE k = n GROUP BY chain
), kept AS (
  SELECT conv_id, n_copies FROM whole WHERE chain NOT IN (SELECT chain FROM prefixes WHERE k < n)
)
SELECT o.conv_id, count(*) AS n_turns, any_value(kept.n_copies) AS n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM ordered o JOIN kept ON o.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY o.conv_id
"""
