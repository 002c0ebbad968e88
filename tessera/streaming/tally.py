"""Tallies of regions that keep arriving. Tallies add up, so running totals are exact whatever the batches are.

Where a tile may be sent again, ``replacing_tally`` keeps each tile's last tally as state and emits differences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.config import Fat
from tessera.operators.classify import CLASSES, REASONS, literals, verdict
from tessera.operators.tally import SUMS, tally_columns


def region_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Regions from Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_tally(regions: DataFrame, cfg: Fat) -> DataFrame:
    """Totals by slide over all that has arrived; for complete or update mode."""
    return regions.groupBy("slide").agg(*tally_columns(verdict(literals(cfg)), cfg.exclude_border))


def windowed_tally(regions: DataFrame, cfg: Fat, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Totals by slide and time window; rows later than the watermark are left out and closed windows leave the state."""
    d = regions.withWatermark(time, late)
    g = d.groupBy(F.window(time, width), "slide").agg(*tally_columns(verdict(literals(cfg)), cfg.exclude_border))
    return g.withColumns({"from_ts": F.col("window.start"), "to_ts": F.col("window.end")}).drop("window")


def append_batches(tallies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's tile tallies once, under the batch's number, so a batch that is run again replaces its own files."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tallies.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of this kind is kept by this provider only.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def contributions(regions: DataFrame, cfg: Fat) -> DataFrame:
    """What each region adds to every sum of a tally, beside (slide, tile, version, label). A row without an area is a tile without regions and adds nothing."""
    v = verdict(literals(cfg))
    accepted = v.isin(*CLASSES)
    border = F.coalesce("touches_border", F.lit(False))
    taken = accepted & ~(border & F.lit(cfg.exclude_border))
    counts = {f"{k}_count": taken & (v == k) for k in CLASSES} | {"border_count": accepted & border}
    counts |= {f"rej_{r}": accepted & border & F.lit(cfg.exclude_border) if r == "border" else v == r for r in REASONS}
    areas = {f"{k}_area_um2": taken & (v == k) for k in CLASSES} | {"border_area_um2": accepted & border}
    there = F.col("area_um2").isNotNull()
    cols = {c: F.when(there & on, F.lit(1)).otherwise(0).cast("long") for c, on in counts.items()} | {c: F.when(there & on, F.col("area_um2")).otherwise(0.0) for c, on in areas.items()}
    return regions.select("slide", "tile", "version", "label", *[cols[c].alias(c) for c in SUMS])


class _Replacing(StatefulProcessor):
    """Holds a tile's version and tally; a newer version replaces it and the difference is emitted, an older or equal one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tally = handle.getValueState("tally", "version long, " + ", ".join(f"{c} {_kind(c)}" for c in SUMS))

    def handleInputRows(self, key, rows, timerValues):
        sent = pd.concat(list(rows))
        version = int(sent["version"].max())
        old = self._tally.get() if self._tally.exists() else None
        if old is not None and version <= old[0]:
            return
        # a file that came twice in one batch repeats its labels
        new = sent[sent["version"] == version].drop_duplicates("label")[list(SUMS)].sum()
        now = [float(new[c]) if _kind(c) == "double" else int(new[c]) for c in SUMS]
        self._tally.update((version, *now))
        was = list(old[1:]) if old is not None else [0] * len(SUMS)
        gap = [a - b for a, b in zip(now, was, strict=True)]
        if old is None or any(gap):
            yield pd.DataFrame([[*key, version, old is None, *gap]], columns=["slide", "tile", "version", "is_new", *SUMS])

    def close(self) -> None:
        pass


def _kind(column: str) -> str:
    return "double" if column.endswith("area_um2") else "long"


def replacing_tally(regions: DataFrame, cfg: Fat) -> DataFrame:
    """A stream of differences (slide, tile, version, is_new, sums): their sum is the tally of the latest version of every tile, however often and in whatever order its files came.

    regions carry ``version``, which grows with each correction of a tile, and ``label``, which tells a tile's regions apart. All rows of one version of a
    tile have to come in one batch, as they do where a file is the unit. State is one row for each tile.
    """
    spark = regions.sparkSession
    spark.conf.set(STORE, ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in regions.schema}
    out = f"slide {kinds['slide']}, tile {kinds['tile']}, version long, is_new boolean, " + ", ".join(f"{c} {_kind(c)}" for c in SUMS)
    return contributions(regions, cfg).groupBy("slide", "tile").transformWithStateInPandas(_Replacing(), outputStructType=out, outputMode="append", timeMode="None")
