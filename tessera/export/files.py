"""Sinks: tables as CSV or Parquet, and exports of pictures with their manifests.

A picture's path is a function of its row. Pictures and manifest are written by the sink of ``sink.py`` and appear together.
"""

from __future__ import annotations

import json
import platform
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, Fat
from tessera.export.sink import FILES, write_pictures
from tessera.functions.scalar import tile_name
from tessera.kernels import draw
from tessera.kernels import raster as K
from tessera.plans.imaging import each_row, each_tile
from tessera.sources import png
from tessera.sources.stores import put

# Decimal places of the columns of a tile table, as existing tables have them.
PLACES = {"tissue_fraction": 4, "threshold": 1} | {f"{k}_area_um2": 1 for k in ("tissue", "macro", "micro", "total", "border")}
PLACES |= {f"{k}_fat_fraction": 6 for k in ("macro", "micro", "total")} | {f"{k}_{m}_area_um2": 2 for k in ("macro", "micro") for m in ("mean", "median")}
MANIFEST = "id string, split string, cohort string, slide string, tile_x int, tile_y int, tile_size int, mpp double, tissue_fraction double, fat_fraction double, label_px long, unanimous_px long, any_px long, unanimous_of_any double, contested_of_label double, is_negative boolean"


def tile_table(df: DataFrame) -> DataFrame:
    """Rounds at the sink only; sums are taken from unrounded columns."""
    return df.withColumns({c: F.bround(F.col(c), p) for c, p in PLACES.items() if c in df.columns})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: str | None = "slide") -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by and by in df.columns else w).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(MANIFEST).csv(path)


def dataset_rows(votes: DataFrame, agree: float = 0.5) -> DataFrame:
    """Manifest rows with the files of each tile: images/, labels/ and confidence/ below the split. votes carries cohort and split."""

    def one(r: dict) -> Iterator[dict]:
        n = r["size"]
        v = np.frombuffer(r["votes"], np.uint8).reshape(n, n)
        label = v >= np.ceil(agree * r["members"])
        name = f"{r['slide']}__tile_x{r['x']:06d}_y{r['y']:06d}"
        mpp, ground = float(np.sqrt(r["um2_per_px"])), r["tissue_area_um2"]
        pictures = {"images": np.frombuffer(r["image"], np.uint8).reshape(n, n, 3), "labels": label * np.uint8(255), "confidence": (v.astype(np.int64) * 255 // r["members"]).astype(np.uint8)}
        any_px, sure, px = int((v > 0).sum()), int((v == r["members"]).sum()), int(label.sum())
        yield {
            "id": name, "split": r["split"], "cohort": r["cohort"], "slide": r["slide"], "tile_x": r["x"], "tile_y": r["y"], "tile_size": n, "mpp": mpp,
            "tissue_fraction": float(np.unpackbits(np.frombuffer(r["ground"], np.uint8), count=n * n).mean()), "fat_fraction": px * r["um2_per_px"] / ground if ground > 0 else 0.0,
            "label_px": px, "unanimous_px": sure, "any_px": any_px, "unanimous_of_any": sure / any_px if any_px else 0.0, "contested_of_label": 1 - sure / px if px else 0.0, "is_negative": r["cohort"] == "negative",
            "files": [{"path": f"{r['split']}/{kind}/{name}.png", "data": png.encode(a, mpp)} for kind, a in pictures.items()],
        }

    return each_row(votes.where("error IS NULL"), one, f"{MANIFEST}, {FILES}")


def export_dataset(votes: DataFrame, root: str, agree: float = 0.5, manifest: str = "manifest") -> DataFrame:
    """Writes the pictures of ``dataset_rows`` below root and returns the manifest."""
    return write_pictures(dataset_rows(votes, agree), root, manifest)


ANNOTATIONS = (
    "annotation_id string, slide string, tile_x int, tile_y int, tile_size int, level int, mpp double, tissue_fraction double, predicted_macro_pct double, predicted_micro_pct double, "
    "predicted_macro_n int, mask_is_prefilled boolean, annotator string, status string"
)
GUIDE = """# Annotation package

images/           tiles as they are
masks_prefilled/  a first guess, white where the engine sees a large region; correct it, or draw from nothing where it is black
overlays/         the guess as an outline, for orientation only
manifest/         one row for each tile; fill in annotator and status (todo, doing, done)
"""


def annotation_rows(spark: SparkSession, tiles: DataFrame, folder: str, cfg: Fat, pattern: str = "*") -> DataFrame:
    """Manifest rows with the files of each tile for annotators: the tile, a prefilled mask, which lies within the tissue, and an overlay."""

    def one(t: dict, rgb: np.ndarray, ground: np.ndarray) -> Iterator[dict]:
        um2 = t["um2_per_px"]
        lab, _ = K.segment(rgb, ground, cfg)
        kinds = [(g, K.judge(g, um2, cfg)) for g in K.regions(lab)]
        mask = K.painted(lab, [g.label for g, k in kinds if k == "macro"])
        pct = {c: round(sum(g.area_px for g, k in kinds if k == c) / max(1, int(ground.sum())) * 100, 3) for c in ("macro", "micro")}
        name = f"{t['slide']}__tile_x{t['x']:06d}_y{t['y']:06d}"
        pictures = {"images": rgb, "masks_prefilled": mask * np.uint8(255), "overlays": draw.outline(rgb, mask)}
        yield {
            "annotation_id": name, "slide": t["slide"], "tile_x": t["x"], "tile_y": t["y"], "tile_size": t["size"], "level": 0, "mpp": float(np.sqrt(um2)), "tissue_fraction": round(float(ground.mean()), 4),
            "predicted_macro_pct": pct["macro"], "predicted_micro_pct": pct["micro"], "predicted_macro_n": sum(k == "macro" for _, k in kinds), "mask_is_prefilled": bool(mask.any()), "annotator": "", "status": "todo",
            "files": [{"path": f"{kind}/{name}.png", "data": png.encode(a)} for kind, a in pictures.items()],
        }

    return each_tile(spark, tiles, folder, one, f"{ANNOTATIONS}, {FILES}", pattern)


def export_annotations(spark: SparkSession, tiles: DataFrame, folder: str, root: str, cfg: Fat, pattern: str = "*", manifest: str = "manifest") -> DataFrame:
    """Writes the pictures of ``annotation_rows`` and a guide below root and returns the manifest."""
    put(f"{root}/README.md", GUIDE.encode())
    return write_pictures(annotation_rows(spark, tiles, folder, cfg, pattern), root, manifest)


def failures(tables: dict[str, DataFrame], cohort: str) -> list[dict]:
    """What could not be read: one record for each slide, stage and error."""
    out = []
    for stage, df in tables.items():
        for r in df.where("error IS NOT NULL").select("slide", "error").distinct().orderBy("slide", "error").collect():
            out.append({"slide": r["slide"], "cohort": cohort, "stage": stage, "error": r["error"]})
    return out


def names(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("id", F.concat(F.col("slide").cast("string"), F.lit("__"), tile_name(F.col("x"), F.col("y"))))


def _git(*args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def provenance(cfg: Config, argv: list[str], inputs: DataFrame | None = None) -> dict:
    """What made a result: time, code state, versions, arguments, parameters, and digests of the inputs if their table is given."""
    import pyspark

    state = _git("status", "--porcelain")
    out = {
        "time": datetime.now(UTC).isoformat(), "commit": _git("rev-parse", "HEAD"), "branch": _git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if state is None else bool(state),
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": np.__version__, "pyarrow": pa.__version__}, "argv": argv, "config_digest": cfg.digest(), "config": cfg.to_dict(),
    }
    if inputs is not None:
        out["inputs"] = {r["path"]: r["sha256"] for r in inputs.collect()}
    return out


def write_json(value: dict | list, path: str) -> None:
    put(path, json.dumps(value, indent=2, sort_keys=True, default=str).encode())
