"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: a minimum per node, then a join that AQE can split."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u") if large else both
    hung = out.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u != v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Every node either hangs on one other or has others hanging on it."""
    ends = (edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")
    return odd.isEmpty()


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, comp)`` of every node with an edge; comp is the smallest node reachable.

    ``edges`` has bigint columns ``u`` and ``v``; loops and repeated edges do
    no harm. Each round is written to the shared folder; the loop ends when
    the written edges are stars, each hanging on its smallest node.
    """
    cur = edges.where("u != v").select("u", "v").distinct()
    k = 0
    while True:
        k += 1
        cur = scratch.write(_star(_star(cur, True), False), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        if _is_stars(cur):
            break
    roots = cur.select(F.col("v").alias("node")).distinct()
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .unionByName(roots.select("node", F.col("node").alias("comp"))))
