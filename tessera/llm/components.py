"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace

#: A node's edges are dealt over so many parts, so that a hub is not one task's work.
SALTS = 16
MAX_ROUNDS = 60


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, salts): the least neighbour of each node, and the parts over which its edges are dealt."""
    part = edges.groupBy("u", "salt").agg(F.min("v").alias("m"))
    return part.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))


def _with_min(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Salted edges (u, v) with m, the least node of u's neighbourhood."""
    spread = least.select("u", "m", F.explode("salts").alias("salt"))
    return edges.join(spread, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _salted(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return _with_min(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _salted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = _least(down)
    moved = _with_min(down, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, work: Workspace, tag: str = "cc") -> DataFrame:
    """(node, component) of every node in edges (a, b): the least node that it reaches. Self-loops may be given.

    Each round is written to the shared folder, and the one before it dropped; the loop ends when a
    round leaves the edges as they were. An empty edge table gives an empty result.
    """
    now = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, n = mark(now), 0
    while seen[0]:
        n += 1
        if n > MAX_ROUNDS:
            raise RuntimeError("star contraction did not settle")
        after = work.save(_small_star(_large_star(now)), f"{tag}-{n}")
        work.drop(f"{tag}-{n - 1}")
        got = mark(after)
        now, same, seen = after, got == seen, got
        if same:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
