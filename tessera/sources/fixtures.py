"""The engine's tables as views of the driver's tables, so that every operator can be held against plain SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Region measures as integer-valued or exactly scaled columns: sums are exact in any order.
COMPONENTS = """
SELECT l_suppkey AS slide, CAST(l_orderkey % 16 AS INT) AS tile, CASE l_linenumber % 3 WHEN 0 THEN 200 WHEN 1 THEN 210 ELSE 220 END AS white,
  l_quantity * l_quantity AS area_um2, CAST(1 AS DOUBLE) - l_discount * CAST(7 AS DOUBLE) AS circularity, CAST(1 AS DOUBLE) - l_tax * CAST(2.7 AS DOUBLE) AS solidity,
  CAST(l_partkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS eccentricity, (l_returnflag = 'R' AND l_linestatus = 'O') AS touches_border
FROM lineitem
"""
SLIDES = "SELECT s_suppkey AS slide, CASE WHEN s_suppkey % 3 = 0 THEN 'positive' ELSE 'negative' END AS cohort FROM supplier"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COMPONENTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SLIDES.replace("FROM supplier", "FROM {supplier}"), supplier=read(spark, sf_dir, "supplier"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen tiles for each slide, in a 4 x 4 grid of 512 pixels."""
    t = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slide"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("tile"))
    return t.select("slide", "tile", (F.col("tile") % 4 * 512).alias("x"), (F.floor(F.col("tile") / 4) * 512).cast("int").alias("y"), (F.lit(50000.0) + F.col("tile") * 1000.0).alias("tissue_area_um2"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h, w, data): one 8 x 8 grey raster for each embedding."""
    grey = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + F.lit(0.55)) * 232).cast("int")))
    hexed = F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(grey(e)), 2, "0")), "")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(hexed).alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, x, gray): the same rasters as one row for each pixel."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "e"))
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + F.lit(0.55)) * 232).cast("int")))
    return e.select("id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), g.alias("gray"))


def image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grey rasters as tiles with packed pixels, one for each slide; the first two columns of a tile are not tissue."""
    crop = np.packbits(np.arange(16).reshape(4, 4) % 4 > 0).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            packed = [None if d is None else zlib.compress(np.repeat(np.frombuffer(d, np.uint8), 3).tobytes(), 1) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["slide", "pixels"])

    d = rasters(spark, sf_dir).select(F.col("id").cast("string").alias("slide"), "data").mapInArrow(run, "slide string, pixels binary").where("pixels IS NOT NULL")
    fixed = {"x": 0, "y": 0, "size": 8, "crop_w": 4, "crop_h": 4}
    return d.select("slide", *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(0.75).alias("tissue_fraction"), F.lit(0.25).alias("um2_per_px"), F.lit(crop).alias("crop"), F.lit(None).cast("string").alias("error"), "pixels")


def colour_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h, w, data): one 3 x 7 colour raster for each embedding, from its first 63 values."""
    return rasters(spark, sf_dir).select("id", F.lit(3).alias("h"), F.lit(7).alias("w"), F.expr("substring(data, 1, 63)").alias("data"))
