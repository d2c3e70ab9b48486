"""Connected components of an edge table by repeated contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) long pairs -> (node, component) for every node of an edge; component is its smallest node.

    Each round, every node moves to the neighbour (or itself) with the smallest
    pseudo-random priority, that neighbour's move follows, and the edges are
    renamed; about half of the nodes go per round, whatever the shape.  Joins are
    plain equi-joins, so one node with very many edges can be split; the choices
    are aggregates that combine before the shuffle.  An empty table gives none.
    """
    live = scratch.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    moves: list[DataFrame] = []
    turn = 0
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("p"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("p"), F.col("a").alias("n"))
        hop = scratch.cut(near.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("to")))
        far = hop.alias("x").join(hop.alias("y"), F.col("x.to") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.to").alias("to"))
        far = scratch.cut(far)
        moves.append(far)
        named = live.join(far.withColumnRenamed("node", "a").withColumnRenamed("to", "a2"), "a").select("a2", "b")
        named = named.join(far.withColumnRenamed("node", "b").withColumnRenamed("to", "b2"), "b").select("a2", "b2")
        after = scratch.cut(named.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        scratch.drop(live, hop)
        live = after
        turn += 1
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    found = moves[0].select("node", F.col("to").alias("root"))
    for step in moves[1:]:
        found = found.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = scratch.cut(found)
    scratch.drop(live, *moves)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.cut(found.join(least, "root").select("node", "component"))
