"""A panel of parameter sets: each judges the regions of its own threshold, and agreement is the confidence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Fat
from tessera.functions.scalar import ratio
from tessera.operators.classify import PARAMETERS, verdict

#: Threshold, least area and greatest eccentricity of the nine members.
MEMBERS = ((200, 20.0, 0.80), (200, 40.0, 0.85), (200, 60.0, 0.75), (210, 20.0, 0.85), (210, 40.0, 0.80), (210, 60.0, 0.80), (220, 20.0, 0.75), (220, 40.0, 0.80), (220, 60.0, 0.85))


#: Fixed format of a member's name.
NAME = "w{}_a{}_e{:.2f}"


def default_members(base: Fat) -> list[tuple[str, Fat]]:
    return [(NAME.format(w, int(a), e), replace(base, white_threshold=w, min_area_um2=a, max_eccentricity=e)) for w, a, e in MEMBERS]


def accepted(components: DataFrame, members: DataFrame) -> DataFrame:
    """(region, member) rows that count: the member's class, less small ones and border regions where it leaves those out."""
    p = {n: F.col(n) for n in PARAMETERS}
    d = components.join(F.broadcast(members.withColumnRenamed("white_threshold", "white")), "white").withColumn("verdict", verdict(p))
    return d.where(((F.col("verdict") == "macro") | ((F.col("verdict") == "micro") & F.col("include_microvesicular"))) & ~(F.col("touches_border") & F.col("exclude_border")))


def member_pct(components: DataFrame, tiles: DataFrame, members: DataFrame) -> DataFrame:
    """(slide, name, pct): accepted area as a percentage of tissue, for every slide with tiles and every member."""
    area = accepted(components, members).groupBy("slide", "name").agg(F.sum("area_um2").alias("area"))
    ground = tiles.groupBy("slide").agg(F.sum("tissue_area_um2").alias("tissue"))
    every = ground.join(F.broadcast(members.select("name")))
    return every.join(area, ["slide", "name"], "left").select("slide", "name", (ratio(F.coalesce("area", F.lit(0.0)), F.col("tissue")) * 100).alias("pct"))


def region_votes(components: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, votes): how many members accept each region."""
    return accepted(components, members).groupBy(*keys).agg(F.count("*").alias("votes"))
