"""Slide files as tables: discovery, metadata, windows of pixels.

Spark lists the files; the task that needs pixels opens its slide by path and reads windows of it, so no file's bytes are
in a row or a shuffle. Two kinds are read by this package from any store that Arrow opens: pyramid files of the TIFF kind by the offsets
of their tiles, and PNG slides row by row, for which a task holds the packed file and the rows of one window. What these cannot
read goes through the optional ``openslide`` library, from a folder that all machines mount.

``format("slides")`` is the same as a data source: a folder or list of files, as a table of slides or of the tiles of pyramid files; filters on
``slide`` and ``level`` reach it, so only the files that they leave are opened.
"""

from __future__ import annotations

import fnmatch
import re
from collections import deque
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.scalar import natural_key
from tessera.sources import png, stores
from tessera.sources.stores import read_file
from tessera.sources.tiff import Directory, TiffSlide, directories, paste, pyramid, unpack

#: The file types that count as slides.
SUFFIXES = ("svs", "tif", "tiff", "ndpi", "mrxs", "scn", "vms", "vmu", "bif", "png")
#: Those that this package reads by offset.
BY_OFFSET = ("svs", "tif", "tiff", "scn", "bif", "ndpi")
LEVEL_STEP, LEVELS = 4, 3
SCHEMA = (
    "slide string, path string, width int, height int, mpp_x double, mpp_y double, vendor string, objective string, "
    "levels array<struct<level:int,w:int,h:int,downsample:double>>, error string"
)


class RasterSlide:
    """A PNG slide with levels made by averaging. Windows that are asked for from top to bottom are read in one pass."""

    def __init__(self, data: bytes, need_scale: bool = True):
        self.width, self.height, self.mpp_x, self.mpp_y = png.header(data)
        if need_scale and not self.mpp_x:
            raise ValueError("the slide has no physical scale")
        self.vendor, self.objective = "png", None
        self._data, self._levels = data, {}
        self._lines, self._held, self._first = iter(()), deque(), self.height + 1

    def levels(self) -> list[tuple[int, int, int, float]]:
        return [(k, max(1, self.width // LEVEL_STEP**k), max(1, self.height // LEVEL_STEP**k), float(LEVEL_STEP**k)) for k in range(LEVELS)]

    def rows(self, top: int, bottom: int) -> np.ndarray:
        """Full-resolution rows; only these are held."""
        if top < self._first:
            self._lines, self._held, self._first = png.lines(self._data), deque(), 0
        while self._first + len(self._held) < bottom:
            r = next(self._lines)
            self._held.append(np.repeat(r, 3, axis=1) if r.shape[1] == 1 else r)
            if self._first < top:
                self._held.popleft()
                self._first += 1
        while self._first < top:
            self._held.popleft()
            self._first += 1
        return np.stack([self._held[i] for i in range(bottom - top)])

    def level(self, k: int) -> np.ndarray:
        if k < 0:
            raise ValueError("a pyramid level is not negative")
        k = min(k, LEVELS - 1)
        if k not in self._levels:
            step = LEVEL_STEP**k
            h, w = max(1, self.height // step), max(1, self.width // step)
            if k == 0 or min(self.height, self.width) < step:
                self._levels[k] = self.rows(0, self.height) if k == 0 else self.rows(0, 1)[:, :1].repeat(h, axis=0).repeat(w, axis=1)
            else:
                part = [self.rows(y * step, (y + 1) * step)[:, : w * step].reshape(step, w, step, 3).mean(axis=(0, 2)) for y in range(h)]
                self._levels[k] = np.stack(part).round().astype(np.uint8)
        return self._levels[k]

    def region(self, x: int, y: int, size: int) -> np.ndarray:
        """Full-resolution pixels; what lies outside is black."""
        out = np.zeros((size, size, 3), np.uint8)
        x0, y0, x1, y1 = max(0, x), max(0, y), min(self.width, x + size), min(self.height, y + size)
        if x1 > x0 and y1 > y0:
            out[y0 - y : y1 - y, x0 - x : x1 - x] = self.rows(y0, y1)[:, x0:x1]
        return out

    def thumbnail(self, longest: int) -> np.ndarray:
        """Never enlarged."""
        scale = min(longest / max(self.width, self.height), 1.0)
        h, w = max(1, round(self.height * scale)), max(1, round(self.width * scale))
        xs = np.arange(w) * self.width // w
        return np.stack([self.rows(y, y + 1)[0, xs] for y in (np.arange(h) * self.height // h).tolist()])


class PyramidSlide:
    """A pyramid file through the optional reader library, which reads windows of each level from the file."""

    def __init__(self, path: str):
        try:
            import openslide
        except ImportError:
            raise ValueError("no reader for this file type is installed") from None
        self._file = openslide.OpenSlide(path)
        self.width, self.height = self._file.dimensions
        p = self._file.properties
        scale = [p.get(f"openslide.mpp-{a}") for a in "xy"]
        if not all(scale):
            raise ValueError("the slide has no physical scale")
        self.mpp_x, self.mpp_y = map(float, scale)
        self.vendor, self.objective = p.get("openslide.vendor"), p.get("openslide.objective-power")

    def levels(self) -> list[tuple[int, int, int, float]]:
        f = self._file
        return [(k, *f.level_dimensions[k], float(f.level_downsamples[k])) for k in range(f.level_count)]

    def _read(self, x: int, y: int, k: int, w: int, h: int) -> np.ndarray:
        return np.asarray(self._file.read_region((x, y), k, (w, h)))[..., :3]

    def level(self, k: int) -> np.ndarray:
        if k < 0:
            raise ValueError("a pyramid level is not negative")
        k = min(k, self._file.level_count - 1)
        return self._read(0, 0, k, *self._file.level_dimensions[k])

    def region(self, x: int, y: int, size: int) -> np.ndarray:
        return self._read(x, y, 0, size, size)

    def thumbnail(self, longest: int) -> np.ndarray:
        return np.asarray(self._file.get_thumbnail((longest, longest)))[..., :3]


def open_slide(path: str, data: bytes | None = None) -> RasterSlide | TiffSlide | PyramidSlide:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "png":
        return RasterSlide(read_file(path) if data is None else data)
    refused = None
    if suffix in BY_OFFSET:
        try:
            return TiffSlide(path)
        except ValueError as e:
            refused = e
        except OSError:
            pass  # not on a store that Arrow opens
    try:
        return PyramidSlide(unquote(re.sub(r"^file:/+", "/", path)))
    except ValueError as e:
        raise refused or e from None


def find_slides(spark: SparkSession, folder: str, pattern: str = "*", ordered: bool = True) -> DataFrame:
    """(slide, path, bytes, sort_key) of the slide files of a folder in natural order; contents are not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    d = d.where(~name.startswith(".") & suffix.isin(*SUFFIXES)).select(stem.alias("slide"), "path", "bytes", natural_key(stem).alias("sort_key"))
    return d.orderBy("sort_key", "path") if ordered else d


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of every file, whatever its size: tasks read by path, a chunk at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stores.digest(path)])], names=["path", "sha256"])

    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return d.mapInArrow(run, "path string, sha256 string")


def describe(slide: str, path: str, data: bytes | None = None) -> tuple:
    """One row of metadata; a file that cannot be read gives a row with its error."""
    try:
        s = open_slide(path, data)
        levels = [dict(zip(("level", "w", "h", "downsample"), x, strict=True)) for x in s.levels()]
        return slide, path, s.width, s.height, s.mpp_x, s.mpp_y, s.vendor, s.objective, levels, None
    except Exception as e:
        return slide, path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def slides(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Metadata of every slide, as in SCHEMA."""

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, describe(r["slide"], r["path"]), strict=True))], schema)

    return find_slides(spark, folder, pattern, ordered=False).select("slide", "path").mapInArrow(run, SCHEMA)


TILES_OF = (
    "slide string, path string, level int, downsample double, level_w int, level_h int, tile_w int, tile_h int, row int, col int, offset long, bytes long, rows int, "
    "compression int, photometric int, samples int, predictor int, error string"
)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_TILES_ARROW = pa.schema([(n, _ARROW[t]) for n, t in (c.split(" ") for c in TILES_OF.split(", "))])


def tiles_of(slide: str, path: str, levels: set[int] | None = None) -> pa.RecordBatch:
    """The tiles of a pyramid file, from its directories alone; a level whose tiles cannot be read, or a file that cannot, is one row with the error."""
    schema = _TILES_ARROW
    parts: dict[str, list] = {n: [] for n in schema.names}

    def add(n: int, **columns) -> None:
        for name in schema.names:
            v = columns.get(name)
            parts[name].append(pa.array(v, schema.field(name).type) if isinstance(v, np.ndarray) else pa.repeat(pa.scalar(v, schema.field(name).type), n))

    try:
        source = stores.Ranges(path)
        found: list[Directory] = pyramid(directories(source))
        source.close()
        for k, d in enumerate(found):
            if levels is not None and k not in levels:
                continue
            down = (found[0].width / d.width + found[0].height / d.height) / 2
            same = {"slide": slide, "path": path, "level": k, "downsample": down, "level_w": d.width, "level_h": d.height, "tile_w": d.tile_w, "tile_h": d.tile_h, "compression": d.compression, "photometric": d.photometric, "samples": d.samples, "predictor": d.predictor}
            if d.refusal():
                add(1, **same, error=f"ValueError: {d.refusal()}")
                continue
            n = np.arange(len(d.offsets))
            rows = np.array([d.tile_rows(r) for r in range(d.rows)])
            add(len(n), **same, row=n // d.columns, col=n % d.columns, offset=d.offsets, bytes=d.sizes, rows=rows[n // d.columns])
    except Exception as e:
        add(1, slide=slide, path=path, error=f"{type(e).__name__}: {e}")
    return pa.RecordBatch.from_arrays([pa.concat_arrays(v) if v else pa.array([], schema.field(n).type) for n, v in parts.items()], schema=schema)


def tile_index(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The tiles of every pyramid file of a folder, as in TILES_OF: where each stands in its file."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for slide, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield tiles_of(slide, path)

    named = find_slides(spark, folder, pattern, ordered=False).where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*BY_OFFSET))
    return named.select("slide", "path").mapInArrow(run, TILES_OF)


#: Rows of windows (in tiles) that a task reads together.
BAND = 8
WINDOWS = "slide string, level int, x int, y int, w int, h int, pixels binary, bytes_read long, error string"


def read_windows(windows: DataFrame, index: DataFrame) -> DataFrame:
    """The pixels (RGB bytes) of windows (slide, level, x, y, w, h), in pixels of their level, as in WINDOWS; what lies outside is black.

    Windows are cut into the places of tiles that they touch, which meet the index by equality; a window's pieces, as many as it
    has tiles, come together again. Windows are dealt over tasks by slide and band of rows and read in the order of their bytes
    in the file; a task opens a file once, and fetches each window's tiles in order of offset. A slide or level without
    tiles gives an error.
    """
    key = ["slide", "level", "x", "y", "w", "h"]
    facts = index.groupBy("slide", "level").agg(*[F.first(c).alias(c) for c in ("path", "level_w", "level_h", "tile_w", "tile_h", "compression", "photometric", "samples", "predictor")], F.max("error").alias("error"))
    d = windows.select(*[F.col(c).cast("string" if c == "slide" else "int").alias(c) for c in key]).distinct().join(facts, ["slide", "level"], "left")
    d = d.withColumn("error", F.when(F.col("path").isNull(), "ValueError: the slide has no such level").otherwise(F.col("error")))

    def places(at: str, size: str, tile: str, whole: str):
        low, high = F.greatest(F.lit(0), F.floor(F.col(at) / F.col(tile))), F.ceil(F.least(F.col(at) + F.col(size), F.col(whole)) / F.col(tile)) - 1
        return F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    some = d.where("error IS NULL").withColumn("row", F.explode(places("y", "h", "tile_h", "level_h"))).withColumn("col", F.explode(places("x", "w", "tile_w", "level_w")))
    pieces = some.select(*key, "row", "col").join(index.where("error IS NULL").select("slide", "level", "row", "col", "offset", "bytes", "rows"), ["slide", "level", "row", "col"])
    pieces = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("offset", "bytes", "row", "col", "rows"))).alias("pieces"))
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps the planner from merging tasks by the bytes of their small rows
    d = d.join(pieces, key, "left").repartition(tasks, "slide", F.floor(F.col("y") / (F.col("tile_h") * BAND))).sortWithinPartitions("path", F.col("pieces")[0]["offset"], "x")
    schema = to_arrow_schema(StructType.fromDDL(WINDOWS))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for b in it:
            for r in b.to_pylist():
                out = {k: r[k] for k in key} | {"error": r["error"], "bytes_read": 0}
                try:
                    if r["error"] is None:
                        if r["path"] != path:
                            path, source = r["path"], stores.Ranges(r["path"])
                        before, a = source.bytes_read, np.zeros((r["h"], r["w"], 3), np.uint8)
                        pieces = [p for p in r["pieces"] or [] if p["bytes"]]
                        got = source.fetch((p["offset"], p["bytes"]) for p in pieces)
                        for p in pieces:
                            tile = unpack(got[p["offset"], p["bytes"]], r["tile_w"], p["rows"], r["compression"], r["photometric"], r["samples"], r["predictor"])
                            paste(a, r["x"], r["y"], tile, p["col"] * r["tile_w"], p["row"] * r["tile_h"], r["level_w"], r["level_h"])
                        out |= {"pixels": a.tobytes(), "bytes_read": source.bytes_read - before}
                except Exception as e:
                    out["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{n: out.get(n) for n in schema.names}], schema)

    return d.mapInArrow(run, WINDOWS)


#: Setting under which filters reach data sources written in Python; without it a source that takes filters is refused.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Makes ``format("slides")`` known to a session, with the setting that it needs."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SlideSource)


class SlideSource(DataSource):
    """``spark.read.format("slides").option("folder", ...)`` after ``register``: files on a path that all tasks can open, one partition each.

    Options: ``folder`` with ``pattern`` (a glob on the file name), or ``paths``, a comma-separated list; ``table`` is ``slides`` (as SCHEMA, the default)
    or ``tiles`` (as TILES_OF).
    """

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        kind = self.options.get("table", "slides")
        if kind not in ("slides", "tiles"):
            raise ValueError(f"no such table: {kind}")
        return TILES_OF if kind == "tiles" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SlideReader(self.options)


def _stem(path: str) -> str:
    return unquote(path.rsplit("/", 1)[-1]).rsplit(".", 1)[0]


def list_slides(folder: str, pattern: str = "*") -> list[str]:
    """Paths of the slide files of a folder, for the driver: names only, no file is opened."""
    store, at = stores.located(folder.rstrip("/"))
    lead = folder.rstrip("/")[: -len(at)] if folder.rstrip("/").endswith(at) else ""
    names = [i.base_name for i in store.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File]
    keep = [n for n in names if not n.startswith(".") and n.rsplit(".", 1)[-1].lower() in SUFFIXES and fnmatch.fnmatchcase(n, pattern)]
    return [f"{lead}{at}/{n}" for n in sorted(keep, key=lambda n: ([p.zfill(20) if p.isdigit() else p.lower() for p in re.findall(r"\d+|\D+", n)], n))]


class _SlideReader(DataSourceReader):
    def __init__(self, options):
        self.tiles = options.get("table", "slides") == "tiles"
        self.paths = [p.strip() for p in options.get("paths", "").split(",") if p.strip()]
        if options.get("folder"):
            self.paths += list_slides(options["folder"], options.get("pattern", "*"))
        if self.tiles:
            self.paths = [p for p in self.paths if p.rsplit(".", 1)[-1].lower() in BY_OFFSET]
        self.levels: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on the slide, and on the level of tiles, is taken over; everything else stays with Spark."""
        for f in filters:
            values = {EqualTo: lambda f: {f.value}, EqualNullSafe: lambda f: {f.value}, In: lambda f: set(f.value)}.get(type(f))
            if values and f.attribute == ("slide",):
                self.paths = [p for p in self.paths if _stem(p) in values(f)]
            elif values and f.attribute == ("level",) and self.tiles and None not in values(f):
                self.levels = values(f) if self.levels is None else self.levels & values(f)
                yield f  # rows with an error of the file have no level
            else:
                yield f

    def partitions(self):
        return [InputPartition(p) for p in self.paths] or [InputPartition(None)]

    def read(self, partition):
        path = partition.value
        if path is None:
            return
        if self.tiles:
            yield tiles_of(_stem(path), path, self.levels)
        else:
            yield describe(_stem(path), path)
