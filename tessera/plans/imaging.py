"""From slide files to measured regions: tissue, tiles, regions, votes. Each step is a narrow pass over rows.

Rows carry paths, never a file's bytes: a task opens the slide of its tiles and reads their windows. The tiles of a slide are dealt
over tasks in bands of rows. Tiles carry a crop of the tissue mask, so measuring needs no join with masks. Failures become rows with an error.

Where several steps look at the same tiles, ``pack_tiles`` reads every slide once and leaves the tiles with their packed pixels as a table in
the order of slide, y and x. Every step takes that table in place of plain tiles, and is then a narrow pass over it; filters on
slide and place reach its row groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.config import Config, Fat
from tessera.kernels import raster as K
from tessera.sources.slides import find_slides, open_slide

#: Rows of tiles that one task reads together.
BAND = 8
TISSUE = "slide string, level int, downsample double, um2_per_px double, threshold double, mask_w int, mask_h int, mask binary, tissue_mm2 double, coverage double, components int, error string"
TILES = "slide string, x int, y int, size int, tissue_fraction double, um2_per_px double, crop_w int, crop_h int, crop binary, error string"
REGIONS = (
    "slide string, x int, y int, white int, label int, area_um2 double, circularity double, solidity double, eccentricity double, equivalent_diameter_um double, "
    "centroid_x double, centroid_y double, touches_border boolean, threshold double, error string"
)
#: Bytes of a row group of the store: some ten packed tiles, so that a filter on place skips most of a slide.
ROW_GROUP = 4 << 20
GROUND = "slide string, x int, y int, tissue_area_um2 double"
VOTES = "slide string, x int, y int, size int, image binary, ground binary, votes binary, members int, tissue_area_um2 double, um2_per_px double, member_pct map<string,double>, error string"


def each_row(df: DataFrame, fn: Callable[[dict], Iterator[dict]], ddl: str) -> DataFrame:
    """fn on every row; an exception gives one row with the row's keys and the error."""

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                try:
                    out = list(fn(r))
                except Exception as e:
                    out = [{k: r.get(k) for k in ("slide", "x", "y", "size") if k in schema.names} | {"error": f"{type(e).__name__}: {e}"}]
                if out:
                    yield pa.RecordBatch.from_pylist([{n: o.get(n) for n in schema.names} for o in out], schema)

    return df.mapInArrow(run, ddl)


def tissue(spark: SparkSession, folder: str, cfg: Config, pattern: str = "*") -> DataFrame:
    """One row for each slide: the tissue mask of the detection level as packed bits, with its statistics."""
    t = cfg.tissue

    def one(r: dict) -> Iterator[dict]:
        s = open_slide(r["path"])
        level, _, _, down = s.levels()[min(t.level, len(s.levels()) - 1)]
        um2 = s.mpp_x * down * s.mpp_y * down
        m, threshold = K.detect_tissue(s.level(level), (s.mpp_x + s.mpp_y) / 2 * down, um2, t)
        yield {
            "slide": r["slide"], "level": level, "downsample": down, "um2_per_px": um2, "threshold": threshold, "mask_w": m.shape[1], "mask_h": m.shape[0], "mask": np.packbits(m).tobytes(),
            "tissue_mm2": float(m.sum()) * um2 / 1e6, "coverage": float(m.mean()), "components": int(K.label(m).max()),
        }

    return each_row(find_slides(spark, folder, pattern, ordered=False).select("slide", "path"), one, TISSUE)


def slide_facts(masks: DataFrame, tiles: DataFrame) -> DataFrame:
    """(slide, tiles_candidate, slide_tissue_mm2, components, otsu): what tissue detection and the whole grid of tiles say of each slide."""
    n = tiles.where("error IS NULL").groupBy("slide").agg(F.count("*").alias("tiles_candidate"))
    known = masks.where("error IS NULL").select("slide", F.col("tissue_mm2").alias("slide_tissue_mm2"), "components", F.col("threshold").alias("otsu"))
    return known.join(n, "slide", "left").select("slide", F.coalesce("tiles_candidate", F.lit(0)).alias("tiles_candidate"), "slide_tissue_mm2", "components", "otsu")


def unpacked(data: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=h * w).reshape(h, w).astype(bool)


def tiles(masks: DataFrame, slides: DataFrame, cfg: Config) -> DataFrame:
    """Full tiles with enough tissue, in raster order within a slide. No pixel of the slide is read."""
    t = cfg.tiling
    if t.level != 0:
        raise ValueError("tiles are cut at full resolution")
    if t.stride <= 0:
        raise ValueError("the stride is positive")

    def one(r: dict) -> Iterator[dict]:
        m = unpacked(r["mask"], r["mask_h"], r["mask_w"])
        ys, xs = np.arange(0, r["height"] - t.tile_size + 1, t.stride), np.arange(0, r["width"] - t.tile_size + 1, t.stride)
        if not len(ys) or not len(xs):
            return
        gy, gx = (a.ravel() for a in np.meshgrid(ys, xs, indexing="ij"))
        part = K.tissue_fractions(m, np.stack([gx, gy, np.full(len(gx), t.tile_size), np.full(len(gx), t.tile_size)], axis=1), r["downsample"])
        for x, y, f in zip(gx.tolist(), gy.tolist(), part.tolist(), strict=True):
            if f >= t.min_tissue_fraction:
                x0, y0, x1, y1 = K.box_in_mask(x, y, t.tile_size, t.tile_size, r["downsample"])
                crop = np.zeros((max(1, y1 - y0), max(1, x1 - x0)), bool)
                inner = m[y0 : min(y1, m.shape[0]), x0 : min(x1, m.shape[1])]
                crop[: inner.shape[0], : inner.shape[1]] = inner
                yield {"slide": r["slide"], "x": x, "y": y, "size": t.tile_size, "tissue_fraction": f, "um2_per_px": r["mpp_x"] * r["mpp_y"], "crop_w": crop.shape[1], "crop_h": crop.shape[0], "crop": np.packbits(crop).tobytes()}

    d = masks.where("error IS NULL").join(slides.where("error IS NULL").select("slide", "width", "height", "mpp_x", "mpp_y"), "slide")
    return each_row(d, one, TILES)


def _with_paths(spark: SparkSession, tiles: DataFrame, folder: str, pattern: str) -> DataFrame:
    """Tiles with the path of their slide, dealt over tasks by slide and band of rows, from top to bottom within a task. A PNG slide is read from the top, so it is one band."""
    d = tiles.where("error IS NULL").join(find_slides(spark, folder, pattern, ordered=False).select("slide", "path"), "slide")
    band = F.when(F.lower("path").endswith(".png"), F.lit(0)).otherwise(F.floor(F.col("y") / (F.col("size") * BAND)))
    # rows are small and the work on each is not: a number keeps the planner from merging tasks by their bytes
    return d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slide", band).sortWithinPartitions("slide", "path", "y", "x")


class _Slides:
    """The slide that a task reads, opened once for all its tiles that follow each other."""

    def __init__(self):
        self.path = self.slide = None

    def __call__(self, path: str):
        if path != self.path:
            self.slide, self.path = open_slide(path), path
        return self.slide


def each_tile(spark: SparkSession, tiles: DataFrame, folder: str, fn: Callable[[dict, np.ndarray, np.ndarray], Iterator[dict]], ddl: str, pattern: str = "*") -> DataFrame:
    """fn(row, pixels, tissue) on every tile; pixels come from the tiles' own column, if they have it, or else from their slides."""
    ground = lambda t: K.resized(unpacked(t["crop"], t["crop_h"], t["crop_w"]), t["size"], t["size"])
    if "pixels" in tiles.columns:

        def stored(t: dict) -> Iterator[dict]:
            yield from fn(t, np.frombuffer(zlib.decompress(t["pixels"]), np.uint8).reshape(t["size"], t["size"], 3), ground(t))

        return each_row(tiles.where("error IS NULL"), stored, ddl)
    slides = _Slides()

    def one(t: dict) -> Iterator[dict]:
        rgb = slides(t["path"]).region(t["x"], t["y"], t["size"])
        yield from fn(t, rgb, ground(t))

    return each_row(_with_paths(spark, tiles, folder, pattern), one, ddl)


def pack_tiles(spark: SparkSession, tiles: DataFrame, folder: str, pattern: str = "*") -> DataFrame:
    """The tiles, with all their columns, and their packed pixels, in the order of slide, y and x within a task. A PNG slide is opened and unpacked once; of a pyramid, each band of rows is."""

    def one(t: dict, rgb: np.ndarray, ground: np.ndarray) -> Iterator[dict]:
        yield t | {"pixels": zlib.compress(rgb.tobytes(), 1)}

    return each_tile(spark, tiles, folder, one, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema), "pixels binary"]), pattern)


def write_store(packed: DataFrame, path: str) -> None:
    """Keeps the order of the rows; small row groups let filters on slide and place skip the others."""
    packed.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_store(spark: SparkSession, path: str, slides: Sequence[str] = (), top: int | None = None, bottom: int | None = None) -> DataFrame:
    """Tiles with their pixels: all, or those of some slides, or with top <= y < bottom."""
    d = spark.read.parquet(path)
    d = d.where(F.col("slide").isin(*slides)) if slides else d
    d = d if top is None else d.where(F.col("y") >= top)
    return d if bottom is None else d.where(F.col("y") < bottom)


def regions(spark: SparkSession, tiles: DataFrame, folder: str, cfg: Config, whites: tuple[int, ...] = (), pattern: str = "*") -> DataFrame:
    """Every region of every tile, measured before any filter, once for each threshold."""
    fat = [replace(cfg.fat, white_threshold=w) for w in (whites or (cfg.fat.white_threshold,))]

    def one(t: dict, rgb: np.ndarray, ground: np.ndarray) -> Iterator[dict]:
        um2 = t["um2_per_px"]
        for f in fat:
            lab, threshold = K.segment(rgb, ground, f)
            for g in K.regions(lab):
                yield {
                    "slide": t["slide"], "x": t["x"], "y": t["y"], "white": f.white_threshold, "label": g.label, "area_um2": g.area_px * um2, "circularity": g.circularity, "solidity": g.solidity,
                    "eccentricity": g.eccentricity, "equivalent_diameter_um": float(np.sqrt(4 * g.area_px / np.pi) * np.sqrt(um2)), "centroid_x": g.centroid_x, "centroid_y": g.centroid_y,
                    "touches_border": g.touches_border, "threshold": threshold,
                }

    return each_tile(spark, tiles, folder, one, REGIONS, pattern)


def tile_ground(tiles: DataFrame) -> DataFrame:
    """(slide, tile, x, y, tissue_area_um2) of every tile, from its mask crop alone."""

    def one(r: dict) -> Iterator[dict]:
        m = K.resized(unpacked(r["crop"], r["crop_h"], r["crop_w"]), r["size"], r["size"])
        yield {"slide": r["slide"], "x": r["x"], "y": r["y"], "tissue_area_um2": float(m.sum()) * r["um2_per_px"]}

    few = tiles.where("error IS NULL").select("slide", "x", "y", "size", "um2_per_px", "crop_w", "crop_h", "crop")
    return each_row(few, one, GROUND).withColumn("tile", F.struct("x", "y"))


def votes(spark: SparkSession, tiles: DataFrame, folder: str, members: list[tuple[str, Fat]], pattern: str = "*") -> DataFrame:
    """Votes of an ensemble for every pixel of every tile, with the tile's pixels."""

    def one(t: dict, rgb: np.ndarray, ground: np.ndarray) -> Iterator[dict]:
        v, pct = K.votes(rgb, ground, members, t["um2_per_px"])
        yield {
            "slide": t["slide"], "x": t["x"], "y": t["y"], "size": t["size"], "image": rgb.tobytes(), "ground": np.packbits(ground).tobytes(), "votes": v.tobytes(), "members": len(members),
            "tissue_area_um2": float(ground.sum()) * t["um2_per_px"], "um2_per_px": t["um2_per_px"], "member_pct": pct,
        }

    return each_tile(spark, tiles, folder, one, VOTES, pattern)
