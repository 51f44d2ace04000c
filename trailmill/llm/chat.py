"""Operator 9, chat formatting: cumulative snapshots of a conversation collapse to the longest one.

Loggers that store a conversation after every turn leave prefixes of it behind. Rolling hashes of
the turn prefixes find the logged conversations that begin a longer one; an anti-join keeps the
others, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm.common import materialise

#: Text before the role, between role and text, and after a turn.
MARKS = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_n", F.isnull("role"), "role", F.isnull("text"), "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, _n, _line, _h1, _h2, _more``: turns numbered from 1, as they are rendered, with 128 bits of the
    prefix that ends there, and whether another turn follows. Turns of equal number are ordered by role and text,
    nulls first; a turn hash depends on its place, so the running exclusive-or of turn hashes depends on
    their order. One sort serves all of this."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    t = t.withColumns({"_n": F.row_number().over(w), "_more": F.lead("conv_id").over(w).isNotNull()})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.concat(F.lit(MARKS[0]), F.coalesce("role", F.lit("")), F.lit(MARKS[1]), F.coalesce("text", F.lit("")), F.lit(MARKS[2]))
    return t.select("conv_id", "_n", line.alias("_line"), F.bit_xor(_turn_hash(1)).over(run).alias("_h1"), F.bit_xor(_turn_hash(2)).over(run).alias("_h2"), "_more")


def maximal_conversations(p: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of ``prefixes``: conversations that begin no longer one; of equal ones
    the smallest id, with how many there were.

    Prefixes are made distinct before they meet the whole conversations, so a first turn that many share
    is one row of the anti-join.
    """
    whole = p.filter("not _more").groupBy("_n", "_h1", "_h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = p.filter("_more").select("_n", "_h1", "_h2").distinct()
    return whole.join(begun, ["_n", "_h1", "_h2"], "left_anti").select("conv_id", F.col("_n").cast("long").alias("n_turns"), "n_copies")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered`` of the maximal conversations: their turns in order, a null
    role or text as an empty one.

    Rows without a conversation id are left out; a repeated turn is a turn; other columns are left out,
    whatever their names. An empty table gives an empty table. Turns are numbered and sorted once,
    written, and read again. A conversation is one value of the result, so one task puts it together.
    """
    p = materialise(prefixes(turns), "prefixes")
    kept = materialise(maximal_conversations(p), "kept")
    mine = p.select("conv_id", "_n", "_line").join(kept.select("conv_id"), "conv_id", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "").alias("rendered")
    return mine.groupBy("conv_id").agg(text).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
