"""Named queries over the driver's tables, and the equivalent SQL for an independent engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import TUNED
from tessera.functions import scalar as S
from tessera.kernels import raster as K
from tessera.operators import classify, ensemble, rasters, sampling, sweep, tally, validate
from tessera.plans import imaging
from tessera.sources import fixtures as fx

FAT = TUNED.fat
WHITE = 140
GRID_WHITES = (200, 210, 220)
GRID_AXES = {"circularity_min": (0.55, 0.65), "min_area_um2": (20.0, 40.0, 60.0), "max_eccentricity": (0.75, 0.8)}
CELLS = 36
SEED = 7


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Rounds floating columns whose last bits depend on the order of summation."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _summary(spark, sf):
    return tally.slide_summary(fx.components(spark, sf), fx.tiles(spark, sf), FAT)


def _members(spark):
    return classify.parameter_table(spark, ensemble.default_members(FAT))


def _sweep(spark, sf, **cell):
    """Every cell of the grid, or those of the given values: the grid is cut before any region is judged."""
    grid = sweep.parameter_grid(spark, GRID_WHITES, GRID_AXES)
    for k, v in cell.items():
        grid = grid.where(F.col(k) == v)
    out = sweep.sweep(fx.components(spark, sf), fx.tiles(spark, sf), grid, FAT, CELLS)
    return out.join(fx.slides(spark, sf).withColumnRenamed("cohort", "group"), "slide")


def _candidates(spark, sf):
    """Tiles with their large-class percentage."""
    d = tally.fractions(tally.dense_tile_tally(fx.components(spark, sf), fx.tiles(spark, sf), FAT))
    return d.select("slide", "x", "y", F.round(F.col("macro_fraction") * 100, 6).alias("macro_pct"))


def _mask(spark, sf, fn):
    return rasters.map_rasters(fx.rasters(spark, sf), rasters.mask_kernel(fn, WHITE), "y int, x int")


def _pixel_sums(px: DataFrame) -> DataFrame:
    return px.groupBy("id").agg(F.count("*").alias("n_px"), F.sum(F.col("y") * 8 + F.col("x")).alias("where_px"))


def _labelled(spark, sf):
    return rasters.map_rasters(fx.rasters(spark, sf), rasters.label_kernel(WHITE), "y int, x int, label int")


def _regions(spark, sf):
    return rasters.region_rows(_labelled(spark, sf))


def component_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    d = classify.with_verdict(fx.components(spark, sf), FAT)
    return d.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("area_um2").alias("area_um2"), F.count(F.when(F.col("touches_border"), 1)).alias("n_border"))


def tile_tally(spark, sf):
    return tally.tile_tally(fx.components(spark, sf), FAT)


def tile_tally_dense(spark, sf):
    return tally.dense_tile_tally(fx.components(spark, sf), fx.tiles(spark, sf), FAT)


def border_excluded(spark, sf):
    from dataclasses import replace

    return tally.tile_tally(fx.components(spark, sf), replace(FAT, exclude_border=True)).select("slide", "tile", "macro_count", "macro_area_um2", "border_count", "rej_border")


def class_stats(spark, sf):
    return _r(tally.class_stats(fx.components(spark, sf), FAT), "mean_area_um2", "median_area_um2")


def slide_summary(spark, sf):
    return _r(_summary(spark, sf), "macro_fraction", "micro_fraction", "total_fraction", "border_share", digits=9)


def _grid_tiles(spark, sf):
    return fx.tiles(spark, sf).withColumns({"size": F.lit(512), "tissue_fraction": F.col("tissue_area_um2") / 65536})


def tile_table(spark, sf):
    """All columns of a tile table, with regions at a tile's border left out."""
    from dataclasses import replace

    d = tally.tile_rows(fx.components(spark, sf), _grid_tiles(spark, sf), replace(FAT, exclude_border=True))
    d = _r(d, *[f"{k}_{m}_area_um2" for k in ("macro", "micro") for m in ("mean", "median")])
    return _r(d, *[f"{k}_fat_fraction" for k in ("macro", "micro", "total")], digits=9)


def slide_report(spark, sf):
    """Totals of the tiles that were looked at, beside the number of all tiles and the tissue of the whole slide."""
    every = fx.tiles(spark, sf)
    some = every.where("x < 1536")
    found = fx.components(spark, sf).join(some.select("slide", "tile"), ["slide", "tile"], "left_semi")
    facts = every.groupBy("slide").agg(F.count("*").alias("tiles_candidate"), (F.sum("tissue_area_um2") / 1e6).alias("slide_tissue_area_mm2"))
    d = tally.with_facts(tally.slide_summary(found, some, FAT), facts)
    d = d.select("slide", "tiles", "tiles_candidate", "slide_tissue_area_mm2", "macro_count", "micro_count", "macro_fraction", "micro_fraction", "border_share")
    return _r(d, "slide_tissue_area_mm2", "macro_fraction", "micro_fraction", "border_share", digits=9)


def cohort_summary(spark, sf):
    d = tally.cohort_summary(_summary(spark, sf).join(fx.slides(spark, sf), "slide"))
    d = d.withColumn("cohort", F.coalesce("cohort", F.lit("all")))
    return _r(d, "macro_mean", "macro_min", "macro_max", "macro_weighted", "micro_weighted", "macro_spread", digits=9)


def _survey(spark, sf, n=6):
    tiles = sampling.sample_tiles(fx.tiles(spark, sf), n, SEED)
    found = fx.components(spark, sf).join(tiles.select("slide", "tile"), ["slide", "tile"], "left_semi")
    return sampling.survey_rows(tally.tile_tally(found, FAT), tiles)


def survey_sample(spark, sf):
    d = _survey(spark, sf)
    return _r(d, *[c for c, t in d.dtypes if t == "double"], digits=9)


def group_stats(spark, sf):
    d = _survey(spark, sf).join(fx.slides(spark, sf), "slide")
    g = d.groupBy("cohort").agg(F.count("*").alias("n"), F.sum("macro_pct").alias("sum_pct"), F.avg("macro_pct").alias("mean_pct"), F.min("macro_pct").alias("min_pct"), F.max("macro_pct").alias("max_pct"))
    return _r(g, "sum_pct", "mean_pct", "min_pct", "max_pct")


def param_grid(spark, sf):
    return sweep.parameter_grid(spark, GRID_WHITES, GRID_AXES)


def sweep_per_slide(spark, sf):
    return _r(_sweep(spark, sf), "macro_pct", "micro_pct", digits=9)


def score_sweep(spark, sf):
    d = sweep.score_sweep(_sweep(spark, sf))
    return _r(d, "pos_mean", "pos_min", "pos_median", "neg_mean", "neg_max", "neg_median", "margin", "ratio", "worst_ratio")


def score_cells(spark, sf):
    return _r(sweep.score_cells(_sweep(spark, sf)), "pos_mean", "pos_min", "neg_mean", "neg_max", "margin", "ratio", "auc")


def auc(spark, sf):
    d = _summary(spark, sf).join(fx.slides(spark, sf), "slide").select(F.lit(1).alias("one"), F.col("cohort").alias("group"), F.col("macro_area_um2").alias("macro_pct"))
    return _r(sweep.auc(d, ["one"]), "auc", digits=9).select("auc")


def top_cells(spark, sf):
    d = sweep.score_cells(_sweep(spark, sf), with_auc=False).select("white", *GRID_AXES, F.round("margin", 6).alias("margin"))
    return sweep.top_cells(d, 5)


def _holdout(spark, sf, repeats=300):
    d = _sweep(spark, sf).withColumns({"macro_pct": F.round("macro_pct", 6)})
    return validate.holdout(spark, d, repeats=repeats, seed=SEED)


def holdout(spark, sf):
    return _r(_holdout(spark, sf), "tune_metric", "test_metric", "test_auc", "test_pos_mean", "test_neg_mean", digits=9)


def stability(spark, sf):
    return _r(validate.stability(_holdout(spark, sf), ["white", *GRID_AXES]), "pct")


def optimism(spark, sf):
    return _r(validate.optimism(_holdout(spark, sf)), "optimism", "test_mean", "test_lo", "test_hi", digits=8)


def bootstrap_ci(spark, sf):
    cell = {"white": 210, "circularity_min": 0.55, "min_area_um2": 40.0, "max_eccentricity": 0.8}
    rows = validate.cell_rows(_sweep(spark, sf, **cell), cell).select("slide", "group", "macro_pct")
    return _r(validate.bootstrap(spark, rows, boots=2000, seed=SEED), "observed", "boot_mean", "ci_lo", "ci_hi", digits=8)


def split_plan(spark, sf):
    sev = _summary(spark, sf).select("slide", F.col("macro_fraction").alias("severity"))
    return sampling.plan_splits(fx.slides(spark, sf).join(sev, "slide", "left"))


def split_random(spark, sf):
    return sampling.random_splits(fx.slides(spark, sf), SEED)


def split_lookup(spark, sf):
    """Only one cohort was planned; the other's slides are unseen."""
    known = sampling.random_splits(fx.slides(spark, sf), SEED).where("cohort = 'positive'")
    return sampling.with_split(fx.slides(spark, sf), known).groupBy("split").agg(F.count("*").alias("n"))


def stratified_pick(spark, sf):
    return sampling.stratified_pick(_candidates(spark, sf), 40, 6, SEED)


def size_histogram(spark, sf):
    return _r(sampling.histogram(fx.components(spark, sf), "area_um2", 12), "lo", "hi")


def ensemble_member_pct(spark, sf):
    return _r(ensemble.member_pct(fx.components(spark, sf), fx.tiles(spark, sf), _members(spark)), "pct", digits=9)


def _votes(spark, sf):
    px = fx.pixels(spark, sf)
    levels = spark.range(9).select((F.lit(100) + F.col("id") * 12).cast("int").alias("level"))
    return px.join(F.broadcast(levels)).groupBy("id", "y", "x").agg(F.count(F.when(F.col("gray") >= F.col("level"), 1)).alias("votes"))


def pixel_votes(spark, sf):
    d = _votes(spark, sf).withColumn("confidence", S.confidence_byte(F.col("votes"), F.lit(9)))
    return d.groupBy("votes", "confidence").agg(F.count("*").alias("n_px"))


def agreement(spark, sf):
    return _r(rasters.agreement(_votes(spark, sf), 9), "unanimous_of_any", "unanimous_of_consensus", "contested_of_consensus", digits=9)


def tile_grid(spark, sf):
    dims = fx.read(spark, sf, "part").select(F.col("p_partkey").alias("slide"), (F.col("p_size") * 64).alias("width"), (F.col("p_size") * 40 + 100).alias("height"))
    g = sampling.tile_grid(dims, 512, 384)
    return g.groupBy("slide").agg(F.count("*").alias("tiles"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def natural_sort(spark, sf):
    stem = F.concat(F.lit("Slide "), F.col("s_suppkey").cast("string"), F.lit("-b"), (F.col("s_suppkey") % 7).cast("string"))
    return fx.read(spark, sf, "supplier").select(stem.alias("stem"), S.natural_key(stem).alias("sort_key"))


def tile_names(spark, sf):
    return fx.tiles(spark, sf).select("slide", "tile", S.tile_name(F.col("x"), F.col("y")).alias("tile_name"))


def slide_seed(spark, sf):
    return fx.slides(spark, sf).select("slide", S.slide_seed(F.col("slide"), SEED).alias("seed"))


def white_mask(spark, sf):
    return fx.pixels(spark, sf).groupBy("id").agg(F.count(F.when(F.col("gray") >= WHITE, 1)).alias("n_white"))


def otsu(spark, sf):
    """Rasters without an id have no row, as in the SQL, whose join by id finds none."""
    return rasters.otsu_thresholds(fx.pixels(spark, sf).where(F.col("id").isNotNull()), "id", "gray")


def morph_open(spark, sf):
    return _pixel_sums(_mask(spark, sf, lambda m: K.opened(m, 1)))


def morph_close(spark, sf):
    return _pixel_sums(_mask(spark, sf, lambda m: K.closed(m, 1)))


def fill_holes(spark, sf):
    return _pixel_sums(_mask(spark, sf, K.filled))


def label_components(spark, sf):
    return _regions(spark, sf).groupBy("id").agg(F.count("*").alias("n"), F.max("area_px").alias("largest"), F.sum("area_px").alias("n_px"))


def region_moments(spark, sf):
    d = _regions(spark, sf).withColumn("diameter_um", S.equivalent_diameter(F.col("area_px"), F.lit(0.25)))
    return _r(d, "centroid_x", "centroid_y", "eccentricity", "diameter_um")


def keep_largest(spark, sf):
    return rasters.keep_largest(_regions(spark, sf), 2).select("id", "label", "area_px")


def small_objects(spark, sf):
    return _pixel_sums(_mask(spark, sf, lambda m: K.without_small(m, 3, corners=True)))


def tissue_fraction(spark, sf):
    px = fx.pixels(spark, sf).where(F.col("gray") >= WHITE)
    box = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(10).alias("size")) for x in (0, 7, 25) for y in (3, 20)])).alias("b")
    boxes = fx.rasters(spark, sf).select("id", F.lit(8).alias("mask_w"), F.lit(8).alias("mask_h"), box).select("id", "mask_w", "mask_h", "b.*")
    return _r(rasters.tile_fractions(px, boxes, 4), "tissue_fraction", digits=9)


def mask_stats(spark, sf):
    px = _labelled(spark, sf).groupBy("id").agg(F.count("*").alias("n_px"), F.count_distinct("label").alias("n_components"))
    d = fx.rasters(spark, sf).select("id").join(px, "id", "left").fillna(0)
    return d.select("id", "n_px", (F.col("n_px") * 0.25).alias("area_um2"), (F.col("n_px") / 64).alias("coverage"), "n_components")


def _image_config():
    from dataclasses import replace

    shape = {"circularity_min": 0.0, "solidity_min": 0.0, "max_eccentricity": 1.0, "micro_circularity_min": 0.0, "micro_solidity_min": 0.0}
    return replace(TUNED, fat=replace(FAT, white_threshold=150, open_radius_px=0, close_radius_px=1, min_area_um2=1.0, max_area_um2=6.0, micro_min_area_um2=0.5, **shape))


def image_regions(spark, sf):
    """Regions of tiles with packed pixels: threshold within the tissue, closing, filling, labelling, measuring."""
    d = imaging.regions(spark, fx.image_tiles(spark, sf), "", _image_config())
    return _r(d.select("slide", "white", "label", "area_um2", "centroid_x", "centroid_y", "eccentricity", "equivalent_diameter_um", "touches_border"), "centroid_x", "centroid_y", "eccentricity", "equivalent_diameter_um")


def image_tally(spark, sf):
    """Regions of those tiles judged and summed by slide, over the tissue of the tiles."""
    store, cfg = fx.image_tiles(spark, sf), _image_config()
    found = imaging.regions(spark, store, "", cfg).withColumn("tile", F.struct("x", "y"))
    d = tally.slide_summary(found, imaging.tile_ground(store), cfg.fat)
    return _r(d.select("slide", "tissue_area_um2", "macro_count", "macro_area_um2", "micro_count", "rej_too_small", "rej_too_large", "border_count", "macro_fraction"), "macro_fraction")


def image_tissue(spark, sf):
    """Tissue of colour rasters: saturation and value, small holes filled, small objects dropped."""
    from tessera.config import Tissue

    cfg = Tissue(method="fixed", saturation_threshold=60, max_value=200, close_radius_um=0, open_radius_um=0, min_object_area_um2=2.0, max_hole_area_um2=1.0)
    kernel = lambda a: [(int(y), int(x)) for y, x in zip(*np.nonzero(K.detect_tissue(a, 1.0, 1.0, cfg)[0]), strict=True)]
    px = rasters.map_rasters(fx.colour_rasters(spark, sf), kernel, "y int, x int")
    return px.groupBy("id").agg(F.count("*").alias("n_px"), F.sum(F.col("y") * 7 + F.col("x")).alias("where_px"))


def panel_candidates(spark, sf):
    d = tally.fractions(tally.dense_tile_tally(fx.components(spark, sf), fx.tiles(spark, sf), FAT)).join(fx.slides(spark, sf), "slide")
    d = d.withColumn("pct", F.round(F.col("macro_fraction") * 100, 6))
    return d.where("cohort <> 'negative' AND tissue_area_um2 > 55000 AND pct BETWEEN 3 AND 10").select("slide", "tile", "pct")


def reason_attribution(spark, sf):
    """Regions of the reference threshold against a label mask at a stricter one: reasons of what the label leaves out."""
    lab, px = _labelled(spark, sf), fx.pixels(spark, sf)
    in_label = lab.join(px, ["id", "y", "x"]).groupBy("id", "label").agg(F.count("*").alias("area_px"), F.avg((F.col("gray") >= WHITE + 20).cast("int")).alias("share"))
    d = in_label.withColumn("reason", F.when(F.col("share") > 0.5, "in label").when(F.col("area_px") < 3, "too_small").otherwise("too_faint"))
    return d.groupBy("reason").agg(F.count("*").alias("n"), F.sum("area_px").alias("n_px"))


def slide_levels(spark, sf):
    """Scale of each pyramid level: clamped levels, area of a pixel, pixel radius of a length."""
    d = fx.read(spark, sf, "part").select(F.col("p_partkey").alias("slide"), F.col("p_size").alias("want"), (F.lit(0.25) + F.col("p_size") / 128).alias("mpp"))
    d = d.withColumn("level", S.resolved_level(F.col("want"), F.lit(3)))
    down = F.pow(F.lit(4.0), F.col("level"))
    return d.select("slide", "level", F.round(S.um2_per_px(F.col("mpp"), F.col("mpp"), down), 6).alias("um2_per_px"), S.radius_px(F.lit(20.0), F.col("mpp") * down).alias("radius_px"))


def shape_measures(spark, sf):
    d = fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("p"))
    g = d.select(S.circularity(F.col("a"), F.col("p")).alias("c"), S.equivalent_diameter(F.col("a"), F.lit(0.25)).alias("e"))
    return g.agg(F.round(F.sum("c"), 3).alias("sum_circularity"), F.round(F.sum("e"), 3).alias("sum_diameter"), F.count(F.when(F.col("c") == 0, 1)).alias("n_zero"))


def tally_merge(spark, sf):
    """Tile tallies merged to slides: the same as counting slides directly."""
    return tally.merge(tally.tile_tally(fx.components(spark, sf), FAT), ("slide",))


def rejected_map(spark, sf):
    d = tally.reasons_map(tally.tile_tally(fx.components(spark, sf), FAT))
    return d.select("slide", "tile", F.explode("rejected").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


NAMES = (
    "component_verdicts tile_tally tile_tally_dense border_excluded class_stats slide_summary cohort_summary survey_sample group_stats param_grid sweep_per_slide score_sweep score_cells auc "
    "top_cells holdout stability optimism bootstrap_ci split_plan split_random split_lookup stratified_pick size_histogram ensemble_member_pct pixel_votes agreement tile_grid natural_sort tile_names slide_seed "
    "white_mask otsu morph_open morph_close fill_holes label_components region_moments keep_largest small_objects tissue_fraction mask_stats panel_candidates reason_attribution slide_levels shape_measures "
    "tally_merge rejected_map tile_table slide_report image_regions image_tally image_tissue"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

from tessera.plans.oracle import SQL as ORACLE_SQL  # noqa: E402, F401
