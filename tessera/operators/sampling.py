"""Seeded samples, split plans and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import sample_key
from tessera.operators.ranks import quantiles
from tessera.operators.rownumbers import number_rows


def sample_tiles(tiles: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n tiles of each slide without replacement, with ``population``, the number there was. n <= 0 takes all.

    A slide's draw depends on its own tiles and the seed alone.
    """
    w = Window.partitionBy("slide")
    d = tiles.withColumn("population", F.count("*").over(w))
    if n <= 0:
        return d
    at = F.row_number().over(w.orderBy(sample_key(seed, F.col("slide"), F.col("x"), F.col("y")), "x", "y"))
    return d.withColumn("draw", at).where(F.col("draw") <= n).drop("draw")


def survey_rows(tally: DataFrame, sampled: DataFrame) -> DataFrame:
    """Slide estimates from the tallies of sampled tiles; every sampled slide has a row."""
    from tessera.functions.scalar import ratio
    from tessera.operators.tally import merge, zero_filled

    ground = sampled.groupBy("slide").agg(F.count("*").alias("sampled"), F.max("population").alias("cand_tiles"), F.sum("tissue_area_um2").alias("tissue_area_um2"))
    d = zero_filled(ground.join(merge(tally, ("slide",)), "slide", "left"))
    tissue, macro, micro = F.col("tissue_area_um2"), F.col("macro_area_um2"), F.col("micro_area_um2")
    return d.select(
        "slide", "cand_tiles", "sampled", (tissue / 1e6).alias("sampled_tissue_mm2"), (ratio(macro, tissue) * 100).alias("macro_pct"), (ratio(micro, tissue) * 100).alias("micro_pct"),
        (ratio(macro + micro, tissue) * 100).alias("total_pct"), F.col("macro_count").alias("macro_n"), F.col("micro_count").alias("micro_n"),
        (F.col("macro_count") / F.col("sampled")).alias("macro_n_per_tile"), (F.col("micro_count") / F.col("sampled")).alias("micro_n_per_tile"),
        ratio(macro, F.col("macro_count")).alias("macro_mean_um2"), (ratio(F.col("border_area_um2"), macro + micro) * 100).alias("border_pct_of_fat"),
    )


def quotas(n: Column, val_fraction: float, test_fraction: float) -> dict[str, Column]:
    few = n <= 2
    part = lambda f: F.when(few, 0).otherwise(F.greatest(F.lit(1), F.bround(n * f).cast("int"))).cast("int")
    test, val = part(test_fraction), part(val_fraction)
    return {"train": (n - test - val).cast("int"), "val": val, "test": test}


def plan_splits(slides: DataFrame, val_fraction: float = 0.2, test_fraction: float = 0.2) -> DataFrame:
    """(cohort, slide, split) from (cohort, slide, severity): every split spans the range of severity.

    Dealing each slide to the split that is furthest from its quota is the same as sorting all places
    (split, j) by the share still open when they are filled; place number i goes to slide number i. Runs at once: slides and
    places are numbered over range partitions, so a cohort may be of any size.
    """
    sizes = slides.groupBy("cohort").agg(F.count("*").alias("n"))
    q = quotas(F.col("n"), val_fraction, test_fraction)
    places = sizes.select("cohort", F.explode(F.array(*[F.struct(F.lit(k).alias("split"), v.alias("quota")) for k, v in q.items()])).alias("s")).where("s.quota > 0")
    places = places.select("cohort", "s.split", "s.quota", F.explode(F.sequence(F.lit(0), F.col("s.quota") - 1)).alias("j"))
    left = (F.col("quota") - F.col("j")) / F.col("quota")
    places = number_rows(places.withColumn("left", left), [F.desc("left"), F.desc("quota"), F.desc("split")], ["cohort"], "at")
    placed = number_rows(slides.select("cohort", "slide", F.coalesce("severity", F.lit(0.0)).alias("severity")), [F.asc("severity"), F.asc("slide")], ["cohort"], "at")
    same = placed["cohort"].eqNullSafe(places["cohort"]) & (placed["at"] == places["at"])
    return placed.join(places, same).select(placed["cohort"], "slide", "split")


def random_splits(slides: DataFrame, seed: int, val_fraction: float = 0.2, test_fraction: float = 0.2) -> DataFrame:
    """(cohort, slide, split) by a seeded shuffle: test first, then validation. Runs at once, as ``plan_splits``."""
    q = quotas(F.col("n"), val_fraction, test_fraction)
    d = number_rows(slides.select("cohort", "slide", sample_key(seed, F.col("slide")).alias("key")), [F.asc("key"), F.asc("slide")], ["cohort"], "at")
    sizes = slides.groupBy(F.col("cohort").alias("of")).agg(F.count("*").alias("n"))
    d = d.join(sizes, d["cohort"].eqNullSafe(sizes["of"]))
    return d.select("cohort", "slide", F.when(F.col("at") <= q["test"], "test").when(F.col("at") <= q["test"] + q["val"], "val").otherwise("train").alias("split"))


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Each row's split by its slide; a slide that was not planned is test."""
    return rows.join(splits.select("slide", "split"), "slide", "left").withColumn("split", F.coalesce("split", F.lit("test")))


def stratified_pick(candidates: DataFrame, n: int, strata: int, seed: int, value: str = "macro_pct") -> DataFrame:
    """At most n rows of (slide, x, y, value), spread over quantile strata of the value, topped up from the rest. The edges of the strata are found at once."""
    edges = quantiles(candidates, value, [i / strata for i in range(1, strata)]) or []
    total = candidates.agg(F.count("*").alias("total"))
    d = candidates.withColumn("key", sample_key(seed, F.col("slide"), F.col("x"), F.col("y"))).join(F.broadcast(total))
    # the stratum is the last whose lower edge is not above the value
    at = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    per = F.greatest(F.lit(1), F.floor(F.least(F.lit(n), F.col("total")) / strata))
    d = d.withColumn("stratum", at)
    # no stratum can give more than n rows, which the planner turns into a limit before the shuffle
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("key", "slide", "x", "y"))).where(F.col("r") <= n)
    first = ranked.withColumn("top_up", (F.col("r") > per).cast("int"))
    return first.orderBy("top_up", F.when(F.col("top_up") == 0, F.col("stratum")), "key", "slide", "x", "y").limit(n).select(*candidates.columns, "stratum", F.col("top_up").cast("boolean").alias("topped_up"))


def histogram(values: DataFrame, column: str, bins: int, width: int = 40) -> DataFrame:
    """(bin, lo, hi, n, bar) over equal bins of [min, max]; empty bins have a row, the last one is closed."""
    ends = values.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).where("lo IS NOT NULL").withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    v = F.col(column).cast("double")
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int"))
    counted = values.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    d = every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * step).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * step).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return d.withColumn("bar", F.bround(F.lit(float(width)) * F.col("n") / F.max("n").over(Window.partitionBy())).cast("int"))


def tile_grid(dims: DataFrame, size: int, stride: int) -> DataFrame:
    """Full tiles of (slide, width, height) in raster order; a slide smaller than a tile has none."""
    if stride <= 0:
        raise ValueError("the stride is positive")
    axis = lambda n: F.when(F.col(n) >= size, F.sequence(F.lit(0), (F.col(n) - size).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    rows = dims.select("slide", F.explode(axis("height")).alias("y"), axis("width").alias("xs"))
    return rows.select("slide", F.explode("xs").alias("x"), "y", F.lit(size).alias("size"))


def limit_tiles(tiles: DataFrame, spark: SparkSession, limit: int) -> DataFrame:
    """The first tiles of each slide in raster order; 0 is no limit. Apply it before any pixel is read."""
    if limit <= 0:
        return tiles
    at = F.row_number().over(Window.partitionBy("slide").orderBy("y", "x"))
    return tiles.withColumn("at", at).where(F.col("at") <= limit).drop("at")
