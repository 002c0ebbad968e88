"""Connected components of pairs by alternating star contraction: no group is gathered, every step is a join or an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir

ROUNDS = 60


def _least_around(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, u, v, m): both directions of every pair, with the least of u and its neighbours."""
    both = pairs.select(*keys, "u", "v").union(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, [*keys, "u"])


def stars(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, root) for every node of the pairs (keys, u, v), whose names are numbers: root is the least node that is reachable. Runs at once.

    Rounds are written to the shared folder. Their number grows with the logarithm of the longest path.
    """
    shared_dir(pairs.sparkSession)  # sets the folder where it is unset
    keys = list(keys)
    now = pairs.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    for _ in range(ROUNDS):
        # neighbours above a node go to the least around it, then each node and those below it go to the least below it
        large = _least_around(now, keys).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(below, [*keys, "u"])
        small = small.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).union(below.select(*keys, "u", F.col("m").alias("v")))
        now = small.distinct().checkpoint()
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            roots = now.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        state = seen
    raise RuntimeError("the contraction has not ended")
