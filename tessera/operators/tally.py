"""Additive totals of verdicts: by tile, by slide, by cohort. Partial sums are merged map-side by every plan here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Fat
from tessera.functions.scalar import ratio
from tessera.operators.classify import CLASSES, REASONS, literals, verdict
from tessera.operators.ranks import _same, group_quantiles

#: Every additive column of a tally.
SUMS = ("macro_count", "micro_count", "macro_area_um2", "micro_area_um2", "border_count", "border_area_um2", *(f"rej_{r}" for r in REASONS))


def tally_columns(v: Column, exclude_border: Column | bool = False) -> list[Column]:
    """Aggregates over regions with verdict v. A border region is counted as such once its class accepts it, and then left out if asked."""
    out = F.lit(exclude_border) if isinstance(exclude_border, bool) else exclude_border
    area, border = F.col("area_um2"), F.col("touches_border")
    accepted = v.isin(*CLASSES)
    taken = accepted & ~(border & out)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, area)), F.lit(0.0))
    count = lambda cond: F.count(F.when(cond, 1))
    cols = [count(taken & (v == k)).alias(f"{k}_count") for k in CLASSES] + [total(taken & (v == k)).alias(f"{k}_area_um2") for k in CLASSES]
    cols += [count(accepted & border).alias("border_count"), total(accepted & border).alias("border_area_um2")]
    return cols + [count(accepted & border & out if r == "border" else v == r).alias(f"rej_{r}") for r in REASONS]


def zero_filled(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=[c for c in SUMS if c in df.columns])


def tile_tally(components: DataFrame, cfg: Fat) -> DataFrame:
    """One row for each tile that has regions."""
    return components.groupBy("slide", "tile").agg(*tally_columns(verdict(literals(cfg)), cfg.exclude_border))


def dense_tile_tally(components: DataFrame, tiles: DataFrame, cfg: Fat) -> DataFrame:
    """One row for every tile of the grid; tiles without regions have zeros."""
    return zero_filled(tiles.join(tile_tally(components, cfg), ["slide", "tile"], "left"))


def class_stats(components: DataFrame, cfg: Fat, by: tuple[str, ...] = ("slide",)) -> DataFrame:
    """Count, total, mean and median area by class and over both. What both classes have together comes from their totals and from counts of values, not from the regions again."""
    d = components.withColumn("klass", verdict(literals(cfg))).where(F.col("klass").isin(*CLASSES))
    every = lambda df: df.unionByName(df.withColumn("klass", F.lit("all")))
    sums = d.groupBy(*by, "klass").agg(F.count("*").alias("n"), F.sum("area_um2").alias("area_um2"), F.count("area_um2").alias("known"))
    sums = every(sums).groupBy(*by, "klass").agg(*[F.sum(c).alias(c) for c in ("n", "area_um2", "known")])
    values = every(d.groupBy(*by, "klass", "area_um2").agg(F.count("*").alias("n")))
    medians, same = _same(sums, group_quantiles(values, [*by, "klass"], "area_um2", {"median_area_um2": 0.5}, "n"), [*by, "klass"])
    mean = F.try_divide(F.col("area_um2"), F.col("known").cast("double")).alias("mean_area_um2")
    return sums.join(medians, same, "left").select(*by, "klass", "n", "area_um2", mean, "median_area_um2")


def tile_rows(components: DataFrame, tiles: DataFrame, cfg: Fat) -> DataFrame:
    """The tile table: for every tile of (slide, tile, x, y, size, tissue_fraction, tissue_area_um2) its counts, areas, fractions, means and medians by class and over both, and its rejections.

    A tile's regions are few, so its medians are taken where its tally is. A fixed threshold stands for tiles without regions too.
    """
    v = verdict(literals(cfg))
    known = "threshold" in components.columns
    taken = v.isin(*CLASSES) & ~(F.col("touches_border") & F.lit(cfg.exclude_border))
    area = {k: F.when(taken & (v == k), F.col("area_um2")) for k in CLASSES}
    middle = [of(area[k]).alias(f"{k}_{name}_area_um2") for k in CLASSES for name, of in (("mean", F.avg), ("median", F.median))]
    level = (F.max("threshold") if known else F.lit(None)).cast("double").alias("threshold")
    found = components.groupBy("slide", "tile").agg(*tally_columns(v, cfg.exclude_border), *middle, level)
    d = fractions(zero_filled(tiles.join(found, ["slide", "tile"], "left")))
    level = F.coalesce("threshold", F.lit(float(cfg.white_threshold))) if cfg.method == "fixed" else F.col("threshold")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    sides = [c for k in CLASSES for c in (f"{k}_count", f"{k}_area_um2", F.col(f"{k}_fraction").alias(f"{k}_fat_fraction"), zero(f"{k}_mean_area_um2"), zero(f"{k}_median_area_um2"))]
    total = [(F.col("macro_count") + F.col("micro_count")).alias("total_count"), (F.col("macro_area_um2") + F.col("micro_area_um2")).alias("total_area_um2"), F.col("total_fraction").alias("total_fat_fraction")]
    place = ["slide", F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), F.col("size").alias("tile_size"), "tissue_fraction", "tissue_area_um2", level.alias("threshold")]
    return d.select(*place, *sides, *total, "border_count", "border_area_um2", *[f"rej_{r}" for r in REASONS])


def with_facts(summary: DataFrame, facts: DataFrame) -> DataFrame:
    """A slide table with what is known of each slide as a whole: the other columns of facts, which has one row for each slide."""
    return summary.join(facts, "slide", "left")


def fractions(df: DataFrame, area: str = "tissue_area_um2") -> DataFrame:
    tissue = F.col(area)
    return df.withColumns(
        {
            "macro_fraction": ratio(F.col("macro_area_um2"), tissue),
            "micro_fraction": ratio(F.col("micro_area_um2"), tissue),
            "total_fraction": ratio(F.col("macro_area_um2") + F.col("micro_area_um2"), tissue),
            "border_share": ratio(F.col("border_area_um2"), F.col("macro_area_um2") + F.col("micro_area_um2")),
        }
    )


def candidates(components: DataFrame, tiles: DataFrame, cfg: Fat) -> DataFrame:
    """(slide, x, y, macro_pct, micro_pct, macro_n) of every tile given: what a stratified choice of tiles looks at."""
    d = fractions(dense_tile_tally(components, tiles, cfg))
    pct = {f"{c}_pct": F.coalesce(f"{c}_fraction", F.lit(0.0)) * 100 for c in ("macro", "micro")}
    return d.select("slide", "x", "y", *[v.alias(k) for k, v in pct.items()], F.col("macro_count").alias("macro_n"))


def slide_summary(components: DataFrame, tiles: DataFrame, cfg: Fat) -> DataFrame:
    """Totals and fractions of every slide that has tiles, with or without regions."""
    ground = tiles.groupBy("slide").agg(F.count("*").alias("tiles"), F.sum("tissue_area_um2").alias("tissue_area_um2"))
    found = components.groupBy("slide").agg(*tally_columns(verdict(literals(cfg)), cfg.exclude_border))
    return fractions(zero_filled(ground.join(found, "slide", "left")))


def cohort_summary(summary: DataFrame, by: str = "cohort") -> DataFrame:
    """Area-weighted and plain fractions by cohort, and over all (a null cohort)."""
    aggs = [
        F.count("*").alias("slides"), F.sum("tiles").alias("tiles"), F.sum("tissue_area_um2").alias("tissue_area_um2"), F.sum("macro_count").alias("macro_count"), F.sum("micro_count").alias("micro_count"),
        F.sum("macro_area_um2").alias("macro_area_um2"), F.sum("micro_area_um2").alias("micro_area_um2"),
        F.avg("macro_fraction").alias("macro_mean"), F.min("macro_fraction").alias("macro_min"), F.max("macro_fraction").alias("macro_max"),
    ]
    g = summary.rollup(by).agg(*aggs)
    weighted = {f"{k}_weighted": ratio(F.col(f"{k}_area_um2"), F.col("tissue_area_um2")) for k in CLASSES}
    return g.withColumns(weighted | {"macro_spread": F.col("macro_max") - F.col("macro_min")})


def merge(tallies: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sums of tallies: the order and grouping of merging does not matter."""
    return tallies.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS if c in tallies.columns])


def reasons_map(df: DataFrame) -> DataFrame:
    """The rejection counters as one sparse map column."""
    entries = F.array(*[F.struct(F.lit(r).alias("k"), F.col(f"rej_{r}").alias("v")) for r in REASONS])
    return df.withColumn("rejected", F.map_from_entries(F.filter(entries, lambda e: e.v > 0)))
