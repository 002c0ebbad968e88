"""Parameter grids: every cell judged from regions measured once, then scored by how well it separates two cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Fat
from tessera.functions.scalar import ratio
from tessera.operators import ranks
from tessera.operators.classify import literals, verdict
from tessera.operators.tally import tally_columns

#: Columns of a sweep that are not parameters.
META = frozenset({"slide", "group", "tiles", "macro_pct", "micro_pct", "macro_n", "tissue_area_um2"})
#: A grid is sent to every task up to this many cells; beyond it the join is left to the planner.
BROADCAST_CELLS = 100_000


def parameter_keys(sweep: DataFrame) -> list[str]:
    return [c for c in sweep.columns if c not in META]


def parameter_grid(spark: SparkSession, whites: Sequence[int], axes: dict[str, Sequence[float]]) -> DataFrame:
    """One row for each combination, the last axis fastest; ``cell`` numbers them."""
    rows: list[tuple] = [(int(w),) for w in whites]
    for values in axes.values():
        rows = [r + (float(v),) for r in rows for v in values]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cell int, white int" + "".join(f", {n} double" for n in axes))


def sweep(components: DataFrame, tiles: DataFrame, grid: DataFrame, base: Fat, cells: int) -> DataFrame:
    """(slide, parameters, tiles, macro_pct, micro_pct, macro_n) for every slide with tiles and every cell.

    components carry ``white``, the threshold that they were segmented at. Verdicts are aggregated
    on the map side to one row for each slide and cell before anything is shuffled.
    """
    names = [c for c in grid.columns if c != "cell"]
    p = literals(base) | {n: F.col(n) for n in names if n != "white"}
    small = F.broadcast(grid) if cells <= BROADCAST_CELLS else grid
    agg = components.join(small, "white").groupBy("slide", "cell").agg(*tally_columns(verdict(p), base.exclude_border))
    ground = tiles.groupBy("slide").agg(F.count("*").alias("tiles"), F.sum("tissue_area_um2").alias("tissue_area_um2"))
    every = ground.join(small)  # each slide has each cell, with or without regions
    out = every.join(agg.select("slide", "cell", "macro_count", "macro_area_um2", "micro_area_um2"), ["slide", "cell"], "left").fillna(0)
    pct = lambda c: ratio(F.col(c), F.col("tissue_area_um2")) * 100
    return out.select("slide", *names, "tiles", pct("macro_area_um2").alias("macro_pct"), pct("micro_area_um2").alias("micro_pct"), F.col("macro_count").alias("macro_n"))


def _of(value: Column, group: str) -> Column:
    return F.when(F.col("group") == group, value)


def _separation(positive: str, negative: str, value: str) -> list[Column]:
    pos, neg = _of(F.col(value), positive), _of(F.col(value), negative)
    return [F.avg(pos).alias("pos_mean"), F.min(pos).alias("pos_min"), F.avg(neg).alias("neg_mean"), F.max(neg).alias("neg_max")]


def _derived(df: DataFrame) -> DataFrame:
    """Margin and ratios; a zero denominator or an absent cohort gives null."""
    return df.withColumns(
        {
            "margin": F.col("pos_min") - F.col("neg_max"),
            "ratio": F.try_divide(F.col("pos_mean"), F.nullif(F.col("neg_mean"), F.lit(0.0))),
            "worst_ratio": F.try_divide(F.col("pos_min"), F.nullif(F.col("neg_max"), F.lit(0.0))),
        }
    )


def score_sweep(df: DataFrame, positive: str = "positive", negative: str = "negative", value: str = "macro_pct") -> DataFrame:
    """One scored row for each cell, best margin first and undefined margins last."""
    keys = parameter_keys(df)
    out = _derived(df.groupBy(*keys).agg(*_separation(positive, negative, value)))
    middle = ranks.group_quantiles(df.where(F.col("group").isin(positive, negative)), [*keys, "group"], value, {"middle": 0.5})
    middle = middle.groupBy(*keys).agg(F.max(_of(F.col("middle"), positive)).alias("pos_median"), F.max(_of(F.col("middle"), negative)).alias("neg_median"))
    middle, same = ranks._same(out, middle, keys)
    out = out.join(middle, same, "left").drop(*[f"{k}_r" for k in keys])
    return out.orderBy(F.desc_nulls_last("margin"), *keys)


def auc(df: DataFrame, keys: Sequence[str], positive: str = "positive", negative: str = "negative", value: str = "macro_pct", slots: int = ranks.SLOTS) -> DataFrame:
    """(keys, auc): the chance that a positive row exceeds a negative one, ties counting half; null for an absent cohort.

    Rows are counted by distinct value first, so ties cost one row; a key's values are ranked in ``slots`` tasks (one is enough where a key has few rows).
    """
    n = df.where(F.col("group").isin(positive, negative)).groupBy(*keys, value).agg(F.count(_of(F.lit(1), positive)).alias("p"), F.count(_of(F.lit(1), negative)).alias("q"))
    g = ranks.pairs_above(n, keys, value, "p", "q", slots)
    return g.select(*keys, F.try_divide(F.col("u"), (F.col("p") * F.col("q")).cast("double")).alias("auc"))


def score_cells(df: DataFrame, slides: DataFrame | None = None, positive: str = "positive", negative: str = "negative", value: str = "macro_pct", with_auc: bool = True) -> DataFrame:
    """Separation of each cell over all slides or those given. AUC is a plan of its own, so callers that leave it out do not pay for it."""
    keys = parameter_keys(df)
    if slides is not None:
        df = df.join(slides.select("slide").distinct(), "slide", "left_semi")
    out = _derived(df.groupBy(*keys).agg(*_separation(positive, negative, value))).drop("worst_ratio")
    return out.join(auc(df, keys, positive, negative, value), keys, "left") if with_auc else out


def top_cells(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("margin"), *[c for c in scored.columns if c not in ("margin",) and c in scored.columns][:5]).limit(n)
