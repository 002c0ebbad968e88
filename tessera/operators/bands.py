"""Regions of masks that no task holds: a mask is a table of bands of rows, and is labelled as a whole.

Each band is labelled by itself. The runs of its first and last row meet those of the neighbouring bands, cut at fixed columns so that
they meet by equality; parts that touch are contracted to regions. A region is numbered by its first pixel, as in the kernel that
labels a whole raster, so the height of the bands has no influence on results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tessera.kernels import raster as K
from tessera.operators.contract import stars
from tessera.operators.rownumbers import number_rows
from tessera.session import shared_dir

#: Bands are rows (id, band, y0, rows, w, bits): band numbers from 0 without gaps, packed bits of rows * w pixels.
COLUMNS = ("id", "band", "y0", "rows", "w", "bits")
#: Columns in which runs of neighbouring bands are looked for together.
BLOCK = 256
PART = "part int, area_px long, sum_x long, sum_y long, min_x int, min_y int, max_x int, max_y int"
RUN = "part int, x0 int, x1 int"


def bits_of(data: bytes, rows: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=rows * w).reshape(rows, w).astype(bool)


def cut_bands(masks: DataFrame, height: int, white: int = 1) -> DataFrame:
    """Bands of the rasters (id, h, w, data), one byte a pixel, foreground at or above white: for masks that a row can hold."""
    schema = StructType([StructField("id", masks.schema["id"].dataType), *StructType.fromDDL("band int, y0 int, rows int, w int, bits binary")])
    names = schema.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                h, w, data = (b.column(k)[i].as_py() for k in (1, 2, 3))
                if data is None:
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h, w) >= white
                cut = [(n, y, len(a[y : y + height]), w, np.packbits(a[y : y + height]).tobytes()) for n, y in enumerate(range(0, h, height))]
                cols = list(zip(*cut, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(cut))), *[pa.array(c, pa.int32()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=names)

    return masks.select("id", "h", "w", "data").mapInArrow(run, schema)


def _parts(lab: np.ndarray, y0: int) -> list[dict]:
    n = int(lab.max()) if lab.size else 0
    if not n:
        return []
    ys, xs = np.nonzero(lab)
    k = lab[ys, xs] - 1
    ys = ys + y0
    low = lambda v: np.minimum.reduceat(v[order], first)
    high = lambda v: np.maximum.reduceat(v[order], first)
    order = np.argsort(k, kind="stable")
    first = np.flatnonzero(np.diff(k[order], prepend=-1))
    cols = (np.arange(1, n + 1), np.bincount(k), np.add.reduceat(xs[order], first), np.add.reduceat(ys[order], first), low(xs), low(ys), high(xs), high(ys))
    return [dict(zip(("part", "area_px", "sum_x", "sum_y", "min_x", "min_y", "max_x", "max_y"), map(int, r), strict=True)) for r in zip(*cols, strict=True)]


def _runs(row: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(row, prepend=0, append=0))
    return [{"part": int(row[a]), "x0": int(a), "x1": int(b)} for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if row[a]]


def _labelled(bands: DataFrame, corners: bool) -> DataFrame:
    """One row for each band: its parts, and the runs of its first and last row."""
    schema = StructType([StructField("id", bands.schema["id"].dataType), *StructType.fromDDL(f"band int, parts array<struct<{_colons(PART)}>>, first array<struct<{_colons(RUN)}>>, last array<struct<{_colons(RUN)}>>")])
    arrow = to_arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                lab = K.label(bits_of(r["bits"], r["rows"], r["w"]), corners)
                yield pa.RecordBatch.from_pylist([{"id": r["id"], "band": r["band"], "parts": _parts(lab, r["y0"]), "first": _runs(lab[0]), "last": _runs(lab[-1])}], arrow)

    return bands.select(*COLUMNS).mapInArrow(run, schema)


def _colons(ddl: str) -> str:
    return ddl.replace(" ", ":").replace(",:", ",")


def _node(band: Column, part: Column) -> Column:
    """Numbers in the order of bands and, within one, of first pixels."""
    return F.shiftleft(band.cast("long"), 32) + part


def part_labels(bands: DataFrame, corners: bool = True) -> DataFrame:
    """(id, band, part, ..., label): every part of every band with its sums, and the number of its region in the whole mask. Runs at once."""
    shared_dir(bands.sparkSession)
    found = _labelled(bands, corners).checkpoint()
    slack = 1 if corners else 0

    def border(side: str, at: Column) -> DataFrame:
        d = found.select("id", at.alias("border"), "band", F.explode(side).alias("r")).select("id", "border", _node(F.col("band"), F.col("r.part")).alias("node"), "r.x0", "r.x1")
        # a run is looked for in every block that it, or a pixel next to it, lies in
        return d.withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("x0") - slack, F.lit(0)) / BLOCK).cast("int"), F.floor((F.col("x1") - 1 + slack) / BLOCK).cast("int"))))

    upper, lower = border("last", F.col("band")), border("first", F.col("band") - 1)
    over, under = upper.withColumnsRenamed({"node": "u", "x0": "a0", "x1": "a1"}), lower.withColumnsRenamed({"node": "v", "x0": "b0", "x1": "b1"})
    touching = over.join(under, ["id", "border", "block"]).where((F.col("a0") < F.col("b1") + slack) & (F.col("b0") < F.col("a1") + slack)).select("id", "u", "v")
    roots = stars(touching, ["id"])
    parts = found.select("id", "band", F.explode("parts").alias("p")).select("id", "band", "p.*").withColumn("node", _node(F.col("band"), F.col("part")))
    parts = parts.join(roots, ["id", "node"], "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    numbered = number_rows(parts.select("id", "root").distinct(), [F.asc("root")], ["id"], "label")
    return parts.join(numbered, ["id", "root"]).drop("root")


def regions(labelled: DataFrame) -> DataFrame:
    """(id, label, area_px, centroid_x, centroid_y, min_x, min_y, max_x, max_y) of every region, from its parts."""
    g = labelled.groupBy("id", "label").agg(*[F.sum(c).alias(c) for c in ("area_px", "sum_x", "sum_y")], *[F.min(c).alias(c) for c in ("min_x", "min_y")], *[F.max(c).alias(c) for c in ("max_x", "max_y")])
    return g.select("id", "label", "area_px", (F.col("sum_x") / F.col("area_px")).alias("centroid_x"), (F.col("sum_y") / F.col("area_px")).alias("centroid_y"), "min_x", "min_y", "max_x", "max_y")


def painted(bands: DataFrame, labelled: DataFrame, corners: bool = True) -> DataFrame:
    """(id, band, y0, rows, w, labels): each band's pixels as 32-bit labels, 0 where ``labelled`` has no row for a part. A band gets its own parts' labels only."""
    names = labelled.groupBy("id", "band").agg(F.collect_list(F.struct("part", "label")).alias("names"))
    schema = StructType([StructField("id", bands.schema["id"].dataType), *StructType.fromDDL("band int, y0 int, rows int, w int, labels binary")])
    arrow = to_arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                lab = K.label(bits_of(r["bits"], r["rows"], r["w"]), corners)
                look = np.zeros(int(lab.max()) + 1, np.int32)
                for x in r["names"] or []:
                    look[x["part"]] = x["label"]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("id", "band", "y0", "rows", "w")} | {"labels": look[lab].tobytes()}], arrow)

    return bands.select(*COLUMNS).join(names, ["id", "band"], "left").mapInArrow(run, schema)


def large_enough(labelled: DataFrame, pixels: int, largest: int = 0) -> DataFrame:
    """The parts of regions of more than so many pixels and, if asked, of the ``largest`` of them by area (the smaller label first among equals)."""
    sizes = labelled.groupBy("id", "label").agg(F.sum("area_px").alias("whole")).where(F.col("whole") > pixels)
    if largest > 0:
        sizes = number_rows(sizes, [F.desc("whole"), F.asc("label")], ["id"], "at").where(F.col("at") <= largest)
    return labelled.join(sizes.select("id", "label"), ["id", "label"], "left_semi")
