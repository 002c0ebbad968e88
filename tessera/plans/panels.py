"""Reports over voted tiles: quick severity, what the labels miss, and why regions are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.config import Fat
from tessera.functions.scalar import ratio
from tessera.kernels import draw
from tessera.kernels import raster as K
from tessera.operators.sampling import sample_tiles
from tessera.sources import png

COUNTS = "slide string, x int, y int, label_px long, unanimous_px long, any_px long, missed_blobs int, missed_share double, tissue_area_um2 double, um2_per_px double"
REASON_ROWS = "slide string, x int, y int, label int, area_um2 double, diameter_um double, verdict string, in_label boolean, touches_border boolean"


def _each(votes: DataFrame, fn, ddl: str) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                n = r["size"]
                rows = fn(r, np.frombuffer(r["image"], np.uint8).reshape(n, n, 3), np.frombuffer(r["votes"], np.uint8).reshape(n, n))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    return votes.where("error IS NULL").mapInArrow(run, ddl)


def tile_counts(votes: DataFrame, agree: float = 0.5, min_px: int = 600) -> DataFrame:
    """Label, unanimous and any-vote pixels of each tile, and how much of its round white blobs the label misses."""

    def one(r: dict, rgb: np.ndarray, v: np.ndarray) -> list[tuple]:
        label = v >= np.ceil(agree * r["members"])
        blobs = K.round_blobs(rgb, min_px)
        missed = blobs & ~label
        big = sum(g.area_px >= min_px for g in K.regions(K.label(missed)))
        share = float(missed.sum() / blobs.sum()) if blobs.any() else None
        return [(r["slide"], r["x"], r["y"], int(label.sum()), int((v == r["members"]).sum()), int((v > 0).sum()), big, share, r["tissue_area_um2"], r["um2_per_px"])]

    return _each(votes, one, COUNTS)


def severity(counts: DataFrame) -> DataFrame:
    """(slide, severity): labelled area over tissue area of the tiles given."""
    g = counts.groupBy("slide").agg(F.sum(F.col("label_px") * F.col("um2_per_px")).alias("fat"), F.sum("tissue_area_um2").alias("tissue"))
    return g.select("slide", ratio(F.col("fat"), F.col("tissue")).alias("severity"))


def quick_tiles(tiles: DataFrame, seed: int, n: int = 8) -> DataFrame:
    """A few tiles of each slide for a severity that only has to order the slides."""
    return sample_tiles(tiles, n, seed)


def best_panels(counts: DataFrame, low_pct: float, high_pct: float, n: int = 10) -> DataFrame:
    """Tiles within a band of labelled percentage, those first whose label misses least; tiles without blobs are left out."""
    pct = ratio(F.col("label_px") * F.col("um2_per_px"), F.col("tissue_area_um2")) * 100
    d = counts.withColumn("pct", pct).where(F.col("pct").between(low_pct, high_pct) & F.col("missed_share").isNotNull())
    return d.orderBy("missed_blobs", "missed_share", "slide", "y", "x").limit(n)


def region_reasons(votes: DataFrame, cfg: Fat, agree: float = 0.5) -> DataFrame:
    """Every region of every tile with its verdict and whether most of it is in the label."""

    def one(r: dict, rgb: np.ndarray, v: np.ndarray) -> list[tuple]:
        label = v >= np.ceil(agree * r["members"])
        lab, _ = K.segment(rgb, np.unpackbits(np.frombuffer(r["ground"], np.uint8), count=v.size).reshape(v.shape).astype(bool), cfg)
        hits, size = np.bincount(lab.ravel(), label.ravel()), np.bincount(lab.ravel())
        um2 = r["um2_per_px"]
        return [
            (r["slide"], r["x"], r["y"], g.label, g.area_px * um2, float(np.sqrt(4 * g.area_px * um2 / np.pi)), K.judge(g, um2, cfg), bool(hits[g.label] > 0.5 * size[g.label]), g.touches_border)
            for g in K.regions(lab)
        ]

    return _each(votes, one, REASON_ROWS)


def reason_counts(reasons: DataFrame, min_area_um2: float) -> DataFrame:
    """How many regions a reader would notice, by verdict and presence in the label."""
    return reasons.where(F.col("area_um2") >= min_area_um2).groupBy("verdict", "in_label").agg(F.count("*").alias("n"), F.sum("area_um2").alias("area_um2"))


def contact_sheets(votes: DataFrame, cfg: Fat, n: int = 16, cols: int = 4, seed: int = 0) -> DataFrame:
    """(slide, png): a sheet of n sampled tiles of each slide beside their outlined regions."""
    few = sample_tiles(votes.where("error IS NULL"), n, seed).select("slide", F.struct("y", "x", "size", "image", "ground", "um2_per_px").alias("t"))
    g = few.groupBy("slide").agg(F.array_sort(F.collect_list("t")).alias("tiles"))
    schema = to_arrow_schema(StructType.fromDDL("slide string, png binary"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                panels = []
                for t in r["tiles"]:
                    rgb = np.frombuffer(t["image"], np.uint8).reshape(t["size"], t["size"], 3)
                    lab, _ = K.segment(rgb, np.unpackbits(np.frombuffer(t["ground"], np.uint8), count=t["size"] ** 2).reshape(rgb.shape[:2]).astype(bool), cfg)
                    kinds = {g.label: K.judge(g, t["um2_per_px"], cfg) for g in K.regions(lab)}
                    macro, micro = (K.painted(lab, [k for k, v in kinds.items() if v == name]) for name in ("macro", "micro"))
                    panels.append(draw.side_by_side([rgb, draw.outline(rgb, macro), draw.two_class_rgb(macro, micro)]))
                yield pa.RecordBatch.from_pylist([{"slide": r["slide"], "png": png.encode(draw.contact_sheet(panels, cols))}], schema)

    return g.mapInArrow(run, "slide string, png binary")
