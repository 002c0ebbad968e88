"""Ranks and exact quantiles of a column, or of many groups of it, without sorting a column or a group in one task.

Rows are counted by distinct value first. The distinct values are cut into slots at approximate quantiles, so each slot is
sorted by a task of its own; what lies below a slot follows from the totals of at most SLOTS rows. Where the cuts fall
has no influence on results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir

SLOTS = 128
#: Slots of quantiles by group: every value is held against all cuts.
GROUP_SLOTS = 32
#: Accuracy of the cuts: a slot is wrong by at most one part in this many.
ACCURACY = 2000


def cuts(value: str, slots: int) -> Column:
    """An aggregate: the values between slots, null without any value."""
    return F.percentile_approx(value, F.array(*[F.lit(i / slots) for i in range(1, slots)]), ACCURACY)


def slot_of(value: Column, edges: Column) -> Column:
    """How many edges are not above the value; a null is in the first slot."""
    return F.coalesce(F.size(F.filter(edges, lambda e: e <= value)), F.lit(0))


def pairs_above(counts: DataFrame, keys: Sequence[str], value: str, p: str, q: str, slots: int = SLOTS) -> DataFrame:
    """(keys, u, p, q): over rows of counts, the p times those q that stand at a smaller value, and half of those at the same; and both sums.

    counts has one row for each key and value, nulls before all values.
    """
    if slots > 1:
        edges = counts.agg(cuts(value, slots).alias("_edges"))
        d = counts.join(F.broadcast(edges)).withColumn("_slot", slot_of(F.col(value), F.col("_edges"))).drop("_edges")
    else:
        d = counts.withColumn("_slot", F.lit(0))
    within = Window.partitionBy(*keys, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_under", F.coalesce(F.sum(q).over(within), F.lit(0)))
    d = d.groupBy(*keys, "_slot").agg(F.sum(F.col(p) * (F.col("_under") + F.col(q) / 2)).alias("_u"), F.sum(p).alias("_p"), F.sum(q).alias("_q"))
    below = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_q").over(below), F.lit(0)))
    return d.groupBy(*keys).agg(F.sum(F.col("_u") + F.col("_p") * F.col("_before")).alias("u"), F.sum("_p").alias("p"), F.sum("_q").alias("q"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], slots: int = SLOTS) -> list[float] | None:
    """Exact quantiles, linear between neighbours, of the values that are not null; None without any.

    Runs at once. The driver receives the cuts, a total for each slot and two values for each share.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).persist()
    try:
        edges = counts.agg(cuts("v", slots)).first()[0]
        if edges is None:
            return None
        d = counts.withColumn("slot", slot_of(F.col("v"), F.array(*[F.lit(e) for e in edges])))
        totals = {r["slot"]: r["n"] for r in d.groupBy("slot").agg(F.sum("n").alias("n")).collect()}
        places = [s * (sum(totals.values()) - 1) for s in shares]
        wanted = sorted({k for x in places for k in (math.floor(x), math.ceil(x))})
        before, at = {}, 0
        for s in sorted(totals):
            before[s], at = at, at + totals[s]
        need = {s: [k - before[s] for k in wanted if before[s] <= k < before[s] + totals[s]] for s in totals}
        up = F.sum("n").over(Window.partitionBy("slot").orderBy("v"))
        hit = F.lit(False)
        for s, ks in need.items():
            for k in ks:
                hit = hit | ((F.col("slot") == s) & (F.col("up") > k) & (F.col("up") - F.col("n") <= k))
        rows = d.where(F.col("slot").isin([s for s, ks in need.items() if ks])).withColumn("up", up).where(hit).collect()
        value_at = {k: next(r["v"] for r in rows if before[r["slot"]] + r["up"] - r["n"] <= k < before[r["slot"]] + r["up"]) for k in wanted}
        return [value_at[math.floor(x)] + (x - math.floor(x)) * (value_at[math.ceil(x)] - value_at[math.floor(x)]) for x in places]
    finally:
        counts.unpersist()


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """right with other names for these columns, and the condition that they are equal, nulls too."""
    right = right.withColumnsRenamed({n: f"{n}_r" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[f"{n}_r"])
    return right, on


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], weight: str | None = None, slots: int = GROUP_SLOTS) -> DataFrame:
    """(keys, name, ...): exact quantiles of each group's values that are not null, linear between neighbours; a group without any has no row.

    ``weight`` tells how often a row's value stands. All groups are cut into the same slots, at approximate quantiles of all values,
    so a slot of a group has at most a slot's share of the rows: a group that holds most rows is spread over tasks. The totals of
    (group, slot), at most ``slots`` rows a group, say which slots hold the wanted ranks; only those are sorted. Runs at once: the counts are
    written, since they are looked at three times.
    """
    keys = list(keys)
    n = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(n.alias("n"))
    shared_dir(df.sparkSession)  # sets the folder where it is unset
    counts = counts.checkpoint()
    edges = counts.agg(cuts("v", slots).alias("edges"))
    counts = counts.join(F.broadcast(edges)).withColumn("slot", slot_of(F.col("v"), F.col("edges"))).drop("edges")
    group = Window.partitionBy(*keys)
    totals = counts.groupBy(*keys, "slot").agg(F.sum("n").alias("t"))
    totals = totals.withColumns({"before": F.coalesce(F.sum("t").over(group.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("t").over(group)})
    place = {name: (F.col("all") - 1) * F.lit(float(share)) for name, share in shares.items()}
    ranks = [F.struct(F.lit(name).alias("name"), side(p).cast("long").alias("rank"), F.lit(k).alias("upper"), (p - F.floor(p)).alias("part")) for name, p in place.items() for k, side in enumerate((F.floor, F.ceil))]
    wanted = totals.withColumn("w", F.explode(F.array(*ranks))).select(*keys, "slot", "before", "t", "w.*").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("t")))
    few, on = _same(counts, wanted.select(*keys, "slot").distinct(), [*keys, "slot"])
    part = counts.join(few, on, "left_semi").withColumn("up", F.sum("n").over(Window.partitionBy(*keys, "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    wanted, on = _same(part, wanted, [*keys, "slot"])
    at = F.col("rank") - F.col("before")
    found = part.join(wanted, on & (at < F.col("up")) & (at >= F.col("up") - F.col("n")))
    pick = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("upper") == k), F.col("v")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    return found.groupBy(*keys).agg(*[(pick(q, 0) + F.when(share(q) > 0, share(q) * (pick(q, 1) - pick(q, 0))).otherwise(0.0)).alias(q) for q in shares])
