"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Parts that each node's edges are spread over when they meet its minimum: a hub's edges aren't one task's.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of least (u, m: one row a node)."""
    salted = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    edges: columns u, v of one ordered type, any order, repeats allowed. Each round is written to the shared folder,
    so a lost executor costs one round at most. A node's neighbours are never gathered: rounds are joins with
    per-node minima, pre-aggregated before the shuffle, and a hub's edges are spread over SALTS parts for the join.
    Rounds end when the edge table repeats itself, told by its count and the sum of its hashes; each round's table is
    deleted when the next one is written.
    """
    now = scratch.cut(_small_star(edges.select("u", "v")), "stars")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        last, now = now, scratch.cut(_small_star(_large_star(now)), "stars")
        scratch.release(last)
    own = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
