"""The verdict on a measured region: one of two classes, or the reason of its rejection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Fat

CLASSES = ("macro", "micro")
REASONS = ("too_small", "too_large", "low_circularity", "low_solidity", "elongated", "border")
#: The parameters that a verdict depends on.
PARAMETERS = (
    "min_area_um2", "max_area_um2", "circularity_min", "solidity_min", "max_eccentricity",
    "micro_min_area_um2", "micro_circularity_min", "micro_solidity_min",
)


def literals(cfg: Fat) -> dict[str, Column]:
    return {p: F.lit(float(getattr(cfg, p))) for p in PARAMETERS}


def verdict(p: Mapping[str, Column], area: Column | None = None) -> Column:
    """An ordered table of cases. No comparison holds for a NaN, so it never rejects a region by its shape."""
    a = F.col("area_um2") if area is None else area
    c, s, e = F.col("circularity"), F.col("solidity"), F.col("eccentricity")
    above = lambda x, limit: ~F.isnan(x) & (x > limit)
    large = F.when(c < p["circularity_min"], "low_circularity").when(s < p["solidity_min"], "low_solidity").when(above(e, p["max_eccentricity"]), "elongated").otherwise("macro")
    small = F.when(c < p["micro_circularity_min"], "low_circularity").when(s < p["micro_solidity_min"], "low_solidity").otherwise("micro")
    return (
        F.when((a >= p["min_area_um2"]) & (a <= p["max_area_um2"]), large)
        .when((a >= p["micro_min_area_um2"]) & (a < p["min_area_um2"]), small)
        .when(above(a, p["max_area_um2"]), "too_large")
        .otherwise("too_small")
    )


def with_verdict(components: DataFrame, cfg: Fat) -> DataFrame:
    return components.withColumn("verdict", verdict(literals(cfg)))


def parameter_table(spark: SparkSession, rows: list[tuple[str, Fat]]) -> DataFrame:
    """Named parameter sets as rows; their number is what the caller lists, so the table may be broadcast."""
    names = [f.name for f in fields(Fat) if f.name not in ("method", "fill_holes", "open_radius_px", "close_radius_px")]
    kinds = {"white_threshold": "int", "include_microvesicular": "boolean", "exclude_border": "boolean"}
    schema = "name string, " + ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names)
    return spark.createDataFrame([(name, *[getattr(f, n) for n in names]) for name, f in rows], schema)
