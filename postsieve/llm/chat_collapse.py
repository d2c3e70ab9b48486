"""Chat formatting: cumulative snapshots collapse to maximal conversations, then render.

A conversation's turns are numbered in the order of (turn, role, text); a row that is
repeated exactly counts once.  The rolling hash of its first k turns combines the hashes
of (place, role, text) by exclusive or, twice with different seeds, so it is a prefix
sum.  A conversation is dropped if its whole hash is the hash of that many turns of a
longer one, or of an equal one with a smaller conv_id: two anti-joins.

Places and prefix hashes are computed in two levels, inside blocks of BLOCK turn
numbers and over the blocks' sums, so a conversation with very many rows is spread over
tasks (rows of one turn number, which a log has once, stay together).  Rendering gives one row per conversation and CHUNK turns, in order.

Defined cases: rows with a null conv_id are left out; a null turn comes first; a null
role is rendered as `user`, a null text as empty; role and text are hashed as they are
(null unlike empty); turns with equal numbers go by role and text; very long texts and
conversations are rendered whole; empty tables give no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import Scratch

BLOCK, CHUNK = 256, 64
_SEEDS = ("a", "b")


def places(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text and the prefix hashes pa, pb up to each turn."""
    t = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").where("conv_id is not null").distinct()
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("long"))
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("conv_id", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.withColumn("in_block", F.row_number().over(inside)).join(sizes, ["conv_id", "block"])
    t = t.withColumn("place", F.col("before") + F.col("in_block"))
    for s in _SEEDS:
        t = t.withColumn(f"h{s}", F.xxhash64(F.lit(s), "place", "role", "text"))
    sums = t.groupBy("conv_id", "block").agg(*[F.bit_xor(f"h{s}").alias(f"x{s}") for s in _SEEDS])
    prior = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"x{s}").over(prior), F.lit(0)).alias(f"b{s}") for s in _SEEDS])
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    t = t.select("conv_id", "block", "turn", "place", "role", "text", *[F.bit_xor(f"h{s}").over(upto).alias(f"i{s}") for s in _SEEDS])
    t = t.join(sums, ["conv_id", "block"])
    return t.select("conv_id", "place", "role", "text", *[F.col(f"i{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"p{s}") for s in _SEEDS])


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no other one holds as a prefix."""
    sizes = placed.groupBy("conv_id").agg(F.max(F.struct("place", "pa", "pb")).alias("m"))
    whole = sizes.select("conv_id", F.col("m.place").alias("n_turns"), F.col("m.pa").alias("pa"), F.col("m.pb").alias("pb"))
    ends = whole.select("conv_id", F.col("n_turns").alias("place"))
    proper = placed.select("conv_id", "place", "pa", "pb").join(ends, ["conv_id", "place"], "left_anti")
    proper = proper.groupBy(F.col("place").alias("n_turns"), "pa", "pb").agg(F.count("*").alias("longer")).drop("longer")
    first = whole.groupBy("n_turns", "pa", "pb").agg(F.min("conv_id").alias("conv_id"))
    return first.join(proper, ["n_turns", "pa", "pb"], "left_anti").select("conv_id", "n_turns")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def render(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, n_turns, chunk, first_turn, rendered: the maximal conversations, in chunks of turns."""
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    # written once: the anti-joins and the rendering read it
    placed = scratch.cut(places(turns))
    kept = placed.select("conv_id", "place", "role", "text").join(maximal(placed), "conv_id")
    chunk = F.floor((F.col("place") - 1) / CHUNK)
    parts = kept.groupBy("conv_id", "n_turns", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", turn_text(F.col("role"), F.col("text")).alias("r")))).alias("parts"))
    return parts.select("conv_id", "n_turns", "chunk", F.col("parts")[0]["place"].alias("first_turn"), F.array_join(F.col("parts.r"), "").alias("rendered"))
