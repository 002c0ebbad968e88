"""Rasters as rows: kernels applied to Arrow batches, and the pixel relations that check them on small rasters.

Production plans keep a raster in one binary column; ``pixels`` is for small rasters and tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.scalar import eccentricity
from tessera.kernels import raster as K


def map_rasters(df: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str, key: str = "id", batch: int = 64) -> DataFrame:
    """Rows (key, *kernel row) from (key, h, w, data): data holds h * w bytes, or three times as many for colour.

    Rasters pass in small batches, so a task holds a few at a time.
    """
    out = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(schema)])
    kinds = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema)]
    names = out.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                keys, rows = [], []
                for i, h, w, data in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if data is None:
                        continue
                    a = np.frombuffer(data, np.uint8)
                    a = a.reshape(h, w, 3) if a.size == 3 * h * w else a.reshape(h, w)
                    for r in kernel(a):
                        keys.append(i)
                        rows.append(r)
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.schema.field(0).type), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return df.select(key, "h", "w", "data").mapInArrow(run, out)


def mask_kernel(fn: Callable[[np.ndarray], np.ndarray], white: int) -> Callable[[np.ndarray], list[tuple]]:
    """(y, x) of every pixel of a mask that fn makes of the pixels at or above white."""
    return lambda a: [(int(y), int(x)) for y, x in zip(*np.nonzero(fn(a >= white)), strict=True)]


def label_kernel(white: int) -> Callable[[np.ndarray], list[tuple]]:
    def run(a: np.ndarray) -> list[tuple]:
        lab = K.label(a >= white)
        return [(int(y), int(x), int(lab[y, x])) for y, x in zip(*np.nonzero(lab), strict=True)]

    return run


def otsu_thresholds(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, threshold) from one row for each pixel: histograms by partial aggregation, of which each key's, at most 256 counts, meets the kernel's exact rule."""
    hist = values.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("int").alias("v")).agg(F.count("*").alias("c"))
    d = hist.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("h")).select(key, "h.v", "h.c")
    out = T.StructType([T.StructField(key, values.schema[key].dataType), T.StructField("threshold", T.IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [K.otsu_level(v, c) for v, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], names=out.names)

    return d.mapInArrow(run, out)


def region_rows(labelled: DataFrame, key: str = "id") -> DataFrame:
    """Moments of labelled pixels (key, label, y, x): area, centroid, bounding box, eccentricity."""
    g = labelled.groupBy(key, "label").agg(
        F.count("*").alias("area_px"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cov"),
    )
    return g.withColumn("eccentricity", eccentricity(F.col("vx"), F.col("vy"), F.col("cov"))).drop("vx", "vy", "cov")


def keep_largest(regions: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n regions of greatest area of each raster, the smaller label first among equals; n = 0 keeps all."""
    if n <= 0:
        return regions
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("area_px"), "label"))
    return regions.withColumn("at", at).where(F.col("at") <= n).drop("at")


def agreement(votes: DataFrame, members: int, agree: float = 0.5, key: str = "id") -> DataFrame:
    """How much of what any member calls positive is certain; votes: one row for each pixel with a vote."""
    need = int(np.ceil(agree * members))
    n = lambda cond: F.count(F.when(cond, 1))
    v = F.col("votes")
    g = votes.groupBy(key).agg(n(v > 0).alias("any_px"), n(v >= need).alias("consensus_px"), n(v == members).alias("unanimous_px"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0)).cast("double")), F.lit(0.0))
    return g.withColumns(
        {
            "unanimous_of_any": share("unanimous_px", "any_px"), "unanimous_of_consensus": share("unanimous_px", "consensus_px"),
            "contested_of_consensus": F.when(F.col("consensus_px") > 0, 1 - share("unanimous_px", "consensus_px")).otherwise(F.lit(0.0)),
        }
    )


def summed_area(mask_px: DataFrame, dims: DataFrame) -> DataFrame:
    """(id, x, y, total): how many mask pixels (id, x, y) stand at or before each pixel of a mask of dims (id, w, h), across and down. Rows and then columns are summed, each by itself."""
    grid = dims.select("id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.sequence(F.lit(0), F.col("w") - 1).alias("xs"))
    grid = grid.select("id", "y", F.explode("xs").alias("x"))
    marked = mask_px.groupBy("id", "x", "y").agg(F.count("*").alias("n"))
    across = Window.partitionBy("id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    d = grid.join(marked, ["id", "x", "y"], "left").withColumn("row", F.sum(F.coalesce("n", F.lit(0))).over(across))
    return d.select("id", "x", "y", F.sum("row").over(down).alias("total"))


def tile_fractions(mask_px: DataFrame, boxes: DataFrame, downsample: int) -> DataFrame:
    """Share of tissue of each box (id, x, y, size, mask_w, mask_h), from four places of the mask's summed areas: work grows with pixels plus boxes."""
    lo = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) / downsample)).cast("int")
    hi = lambda c, n: F.least(F.col(n), F.ceil((F.col(c) + F.col("size")) / downsample)).cast("int")
    b = boxes.withColumns({"x0": lo("x"), "y0": lo("y"), "x1": hi("x", "mask_w"), "y1": hi("y", "mask_h")})
    dims = boxes.groupBy("id").agg(F.max("mask_w").alias("w"), F.max("mask_h").alias("h")).where("w > 0 AND h > 0")
    table = summed_area(mask_px.select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")), dims).withColumnsRenamed({"x": "px", "y": "py"})
    corners = F.array(*[F.struct((F.col(cx) - 1).alias("px"), (F.col(cy) - 1).alias("py"), F.lit(sign).alias("sign")) for cx, cy, sign in (("x1", "y1", 1), ("x0", "y1", -1), ("x1", "y0", -1), ("x0", "y0", 1))])
    full = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    seen = b.where(full).select("id", "x", "y", "size", F.explode(corners).alias("c")).select("id", "x", "y", "size", "c.*").where("px >= 0 AND py >= 0")
    hits = seen.join(table, ["id", "px", "py"]).groupBy("id", "x", "y", "size").agg(F.sum(F.col("sign") * F.col("total")).alias("hits"))
    n = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return b.join(hits, ["id", "x", "y", "size"], "left").select("id", "x", "y", "size", F.when(~full, F.lit(0.0)).otherwise(F.coalesce("hits", F.lit(0)) / n).alias("tissue_fraction"))
