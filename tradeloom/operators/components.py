"""Weakly connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.session import discard, durable


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Link neighbours of each node to the smallest id among them and the node.

    The minimum is a partial aggregate, so a hub costs one row per task; the
    join back is an equi-join that adaptive execution can split.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = edges.join(low, "u")
    out = out.where(F.col("v") > F.col("u")) if keep_larger else out
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out if keep_larger else out.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` with the smallest node id of each component.

    Nodes appear if an edge names them. The driver holds one row count and one
    checksum a round. Running out of rounds raises an error, never a partial answer.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    state = durable(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True).where("a <> b").distinct()
        # stars keep every node that is not a centre; lone self-edges are dropped and centres come back at the end
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).where("a <> b").distinct()
        old, state = state, durable(small)
        discard(old)
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    centres = state.select(F.col("b").alias("node"), F.col("b").alias("component"))
    lone = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    members = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(centres.unionByName(lone)).groupBy("node").agg(F.min("component").alias("component"))
