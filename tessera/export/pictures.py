"""Pictures of runs: tiles with their masks, checks of tiles and tissue, and figures of an exported dataset.

Files have names that follow from their row; they and the table of what was drawn are written together by the sink of ``sink.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.export.sink import FILES, write_pictures
from tessera.kernels import draw, figures
from tessera.kernels import raster as K
from tessera.operators.sampling import sample_tiles
from tessera.plans import imaging
from tessera.sources import png
from tessera.sources.slides import find_slides, open_slide
from tessera.sources.stores import put, read_file

DRAWN = "slide string, x int, y int, size int, tile string, mask string, qc string, caption string, error string"
KINDS = ("images", "labels", "confidence")


def flagged(grid: DataFrame, cfg: Config) -> DataFrame:
    """grid with ``checked``, whether a figure is made of the tile. Flag tiles before their pixels are packed: this joins."""
    n = cfg.qc.contact_sheet_tiles if cfg.qc.save_per_tile_qc else 0
    some = sample_tiles(grid.select("slide", "x", "y"), max(1, n), cfg.qc.random_seed).select("slide", "x", "y", F.lit(n > 0).alias("checked"))
    return grid.join(some, ["slide", "x", "y"], "left").withColumn("checked", F.coalesce("checked", F.lit(False)))


def chosen(grid: DataFrame, cfg: Config) -> DataFrame:
    """The tiles of which pictures are made, with ``checked``: all tiles if tiles are saved, else the checked ones."""
    d = grid if "checked" in grid.columns else flagged(grid, cfg)
    return d if cfg.tiling.save_tiles else d.where("checked")


def save_tiles(spark: SparkSession, grid: DataFrame, folder: str, cfg: Config, root: str, pattern: str = "*") -> DataFrame:
    """Writes tiles/, masks/ and qc/ below root/<slide>/ for the tiles given, and returns the paths, a table that stands in root/drawn. A mask holds the large class, and the small one if it is labelled."""

    def one(t: dict, rgb: np.ndarray, ground: np.ndarray) -> Iterator[dict]:
        um2, name = t["um2_per_px"], f"tile_x{t['x']:06d}_y{t['y']:06d}"
        lab, _ = K.segment(rgb, ground, cfg.fat)
        found = [(g, K.judge(g, um2, cfg.fat)) for g in K.regions(lab)]
        classes = {c: K.painted(lab, [g.label for g, k in found if k == c]) for c in ("macro", "micro")}
        caption = figures.tile_caption({c: [g.area_px * um2 for g, k in found if k == c] for c in classes}, float(ground.sum()) * um2)
        row = {k: t[k] for k in ("slide", "x", "y", "size")} | {"caption": caption, "files": []}

        def add(column: str, path: str, picture: bytes) -> None:
            row[column] = f"{root}/{path}"
            row["files"].append({"path": path, "data": picture})

        if cfg.tiling.save_tiles:
            label = classes["macro"] | classes["micro"] if cfg.fat.include_microvesicular else classes["macro"]
            add("tile", f"{t['slide']}/tiles/{name}.png", png.encode(rgb, float(np.sqrt(um2))))
            add("mask", f"{t['slide']}/masks/{name}_mask.png", png.encode(label * np.uint8(255)))
        if t["checked"]:
            add("qc", f"{t['slide']}/qc/{name}_qc.png", png.encode(figures.tile_figure(rgb, classes["macro"], classes["micro"], cfg.qc.macro_color, cfg.qc.micro_color, cfg.qc.outline_thickness, f"{name} {caption}")))
        yield row

    return write_pictures(imaging.each_tile(spark, grid, folder, one, f"{DRAWN}, {FILES}", pattern), root, "drawn")


def tissue_figures(spark: SparkSession, masks: DataFrame, folder: str, cfg: Config, root: str, pattern: str = "*") -> DataFrame:
    """Writes root/<slide>_tissue.png for every slide with a mask; (slide, figure, error), a table that stands in root/drawn."""

    def one(r: dict) -> Iterator[dict]:
        thumb = open_slide(r["path"]).thumbnail(cfg.qc.thumbnail_max_dim)
        caption = f"{r['slide']} tissue {r['tissue_mm2']:.2f} mm2 ({100 * r['coverage']:.1f}%), {r['components']} parts"
        picture = png.encode(figures.tissue_figure(thumb, imaging.unpacked(r["mask"], r["mask_h"], r["mask_w"]), cfg.qc.outline_color, cfg.qc.outline_thickness, caption))
        yield {"slide": r["slide"], "figure": f"{root}/{r['slide']}_tissue.png", "files": [{"path": f"{r['slide']}_tissue.png", "data": picture}]}

    d = masks.where("error IS NULL").join(find_slides(spark, folder, pattern, ordered=False).select("slide", "path"), "slide")
    return write_pictures(imaging.each_row(d, one, f"slide string, figure string, error string, {FILES}"), root, "drawn")


def label_pictures(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """manifest with the paths of each row's files below root/<split>/<kind>/<id>.png; null where a file is missing. Files are listed, not read."""
    at = lambda k: F.regexp_extract("path", r"/([^/]+)/([^/]+)/([^/]+)\.png$", k)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select("path")
    listed = listed.select(at(1).alias("split"), at(2).alias("kind"), at(3).alias("id"), "path").where(F.col("kind").isin(*KINDS))
    found = listed.groupBy("split", "id").agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(f"{k}_path") for k in KINDS])
    return manifest.join(found, ["split", "id"], "left")


def load_label(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixels, label, confidence from 0 to 1) of a row of label_pictures."""
    image, label, confidence = (png.decode(read_file(row[f"{k}_path"])) for k in KINDS)
    return image, label.reshape(image.shape[:2]) > 127, confidence.reshape(image.shape[:2]) / 255.0


def save_figure(rgb: np.ndarray, stem: str) -> list[str]:
    """The picture as stem.png and stem.pdf."""
    for ending, data in (("png", png.encode(rgb)), ("pdf", figures.pdf(rgb))):
        put(f"{stem}.{ending}", data)
    return [f"{stem}.png", f"{stem}.pdf"]


def dataset_figures(rows: DataFrame, titles: dict[str, str], members: int, root: str, heading: str = "Labels of large droplets") -> list[str]:
    """Figures of the rows of label_pictures named in ``titles`` (id to title, the first one also alone): overview, pair, agreement, and each picture by itself.

    As many rows as there are titles come to the driver.
    """
    have = {r["id"]: r.asDict() for r in rows.where(F.col("id").isin(*titles)).collect()}
    missing = [i for i in titles if i not in have or not have[i]["images_path"]]
    if missing:
        raise KeyError(f"no pictures of {missing}")
    seen = {i: (have[i], *load_label(have[i])) for i in titles}
    row, image, label, confidence = next(iter(seen.values()))
    votes = lambda c: np.ceil(c * members - 1e-9).astype(np.int64)
    pct = lambda r: 100 * r["fat_fraction"]
    out = save_figure(figures.main_figure([(titles[i], im, la, pct(r)) for i, (r, im, la, _) in seen.items()], row["mpp"], heading), f"{root}/overview")
    out += save_figure(figures.pair_figure(image, label, pct(row), row["mpp"]), f"{root}/pair")
    out += save_figure(figures.confidence_figure(image, label, votes(confidence), members, row["mpp"]), f"{root}/agreement")
    for i, (_, im, la, c) in seen.items():
        for kind, picture in (("image", im), ("label", figures.overlay(im, la)), ("agreement", draw.confidence_rgb(votes(c), members))):
            out.append(f"{root}/panels/{i}_{kind}.png")
            put(out[-1], png.encode(picture))
    return out
