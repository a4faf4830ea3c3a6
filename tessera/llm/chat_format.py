"""Chat formatting by cumulative-snapshot collapse. DataFrame operations only.

Loggers often store a conversation anew after each turn. Rolling turn-prefix hashes (two 64-bit
hashes over position, role and text, folded by running exclusive-or) identify conversations that
are a prefix of a longer one; an anti-join drops them. Of equal conversations the one with the
smallest conv_id stays. The maximal conversations are then rendered as text.

Turns are ordered by turn, then role and text; turns repeated in every column count once. A null role
renders as ``user``, a null text as empty; null turns come first. A row with a null conv_id belongs to no
known conversation and is one of a single turn; equal ones are copies, whose conv_id is null unless a
conversation with an id equals them. Control marks inside texts are broken up, so a text cannot open a turn.
Extra columns are of no account, and an empty table gives no rows. Only distinct prefixes are joined, so a
first turn shared by everyone is one row. A conversation of any number of turns is one row of the result,
as long as its text; its turns are sorted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable


def _hashes() -> list:
    """Two hashes of a turn's place, role and text."""
    return [F.xxhash64("i", "role", "text").alias("x"), F.xxhash64("text", "role", "i", F.lit("b")).alias("y")]


def _rendered(convs: DataFrame) -> DataFrame:
    return convs.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _turns(convs: DataFrame) -> DataFrame:
    """The turns of the conversations that have an id."""
    return _rendered(convs).where("conv is not null").distinct()


def _single_turns(convs: DataFrame) -> DataFrame:
    """i, a, b, role, text, n_copies: the different rows without a conv_id as conversations of one turn, counted before they are shuffled."""
    rows = _rendered(convs).where("conv is null").groupBy("role", "text").agg(F.count("*").alias("n_copies")).withColumn("i", F.lit(1))
    return rows.select("i", *_hashes(), "role", "text", "n_copies").withColumnsRenamed({"x": "a", "y": "b"})


def turn_prefixes(convs: DataFrame) -> DataFrame:
    """conv, i, n, a, b: for each turn number i of n the hashes of the first i turns."""
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = _turns(convs).select("conv", "turn", "role", "text", F.row_number().over(order).alias("i"))
    h = t.select("conv", "i", *_hashes())
    upto = W.partitionBy("conv").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return h.select("conv", "i", F.count("*").over(W.partitionBy("conv")).alias("n"), F.bit_xor("x").over(upto).alias("a"), F.bit_xor("y").over(upto).alias("b"))


def maximal_conversations(convs: DataFrame) -> DataFrame:
    """conv, n_copies, role, text: the conversations that no longer one extends, one of each group of equals.

    conv is null for single turns without an id; these alone carry their role and text.
    """
    p = durable(turn_prefixes(convs), "prefixes")
    singles = _single_turns(convs)
    whole = p.where("i = n").select("i", "a", "b", "conv", F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    alone = singles.select("i", "a", "b", F.lit(None).cast("long").alias("conv"), "n_copies", "role", "text")
    equal = whole.unionByName(alone).groupBy("i", "a", "b").agg(F.min("conv").alias("conv"), F.sum("n_copies").alias("n_copies"), F.max("role").alias("role"), F.max("text").alias("text"))
    inner = p.where("i < n").select("i", "a", "b").distinct()
    return equal.join(inner, ["i", "a", "b"], "left_anti").select("conv", "n_copies", "role", "text")


def _chat(turns):
    """The text of an array of turns in order."""
    safe = lambda t: F.replace(t["text"], F.lit("<|"), F.lit("< |"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), safe(t), F.lit("<|im_end|>\n"))), "")


def format_chats(convs: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat, the rendered text, of every maximal conversation."""
    kept = durable(maximal_conversations(convs), "maximal")
    turns = _turns(convs).join(kept.where("conv is not null").select("conv", "n_copies"), "conv")
    ordered = turns.groupBy("conv").agg(F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    alone = kept.where("conv is null").select("conv", "n_copies", F.array(F.struct(F.lit(None).cast("long").alias("turn"), "role", "text")).alias("ts"))
    every = ordered.select("conv", "n_copies", "ts").unionByName(alone)
    return every.select(F.col("conv").alias("conv_id"), F.size("ts").cast("long").alias("n_turns"), "n_copies", _chat("ts").alias("chat"))
