"""Tiles with their pixels as a table, and pictures written with a commit."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.export import sink
from tessera.operators import tally
from tessera.plans import imaging
from tessera.sources import png, tiff
from tessera.sources import slides as src
from tests.test_imaging import CFG, disc


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("slides")
    for name, n in (("s10", 3), ("s9", 1), ("p1", 2), ("p2", 1)):
        rgb = np.full((256, 384, 3), 252, np.uint8)
        rgb[:, :256] = (190, 100, 150)
        for i in range(n):
            disc(rgb, 60 + 100 * (i % 2), 40 + 70 * i, 14)
        if name[0] == "s":
            (d / f"{name}.png").write_bytes(png.encode(rgb, 0.5))
        else:
            (d / f"{name}.tif").write_bytes(tiff.encode([rgb, rgb[::4, ::4]], (64, 64), mpp=0.5, big=name == "p2"))
    return str(d)


def grid_of(spark, folder):
    return imaging.tiles(imaging.tissue(spark, folder, CFG), src.slides(spark, folder), CFG)


def test_steps_over_the_store_equal_steps_over_slides(spark, folder, tmp_path):
    grid = grid_of(spark, folder)
    imaging.write_store(imaging.pack_tiles(spark, grid, folder), f"{tmp_path}/store")
    store = imaging.read_store(spark, f"{tmp_path}/store")
    assert store.count() == grid.count() == 16 and {r.slide for r in store.select("slide").distinct().collect()} == {"s9", "s10", "p1", "p2"}
    key = lambda r: tuple(map(str, r))
    a = sorted(map(key, imaging.regions(spark, grid, folder, CFG, (200, 210)).collect()))
    assert a == sorted(map(key, imaging.regions(spark, store, "/nowhere", CFG, (200, 210)).collect())) and len(a) > 8
    ground = imaging.tile_ground(store)
    assert sorted(map(key, ground.collect())) == sorted(map(key, imaging.tile_ground(grid).collect()))
    assert "pixels" not in ground._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    found = imaging.regions(spark, store, "/nowhere", CFG).withColumn("tile", F.struct("x", "y"))
    assert {r.slide: r.macro_count for r in tally.slide_summary(found, ground, CFG.fat).collect()} == {"s9": 1, "s10": 3, "p1": 2, "p2": 1}


def test_filters_reach_the_row_groups_of_the_store(spark, folder, tmp_path):
    imaging.write_store(imaging.pack_tiles(spark, grid_of(spark, folder), folder), f"{tmp_path}/store")
    some = imaging.read_store(spark, f"{tmp_path}/store", ["s10"], 128, 256)
    plan = some._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "EqualTo(slide,s10)" in pushed and "GreaterThanOrEqual(y,128)" in pushed and "LessThan(y,256)" in pushed
    assert sorted((r.x, r.y) for r in some.collect()) == [(0, 128), (128, 128)]


def test_a_slide_that_is_unpacked_from_the_top_has_one_task(spark, folder):
    d = imaging._with_paths(spark, grid_of(spark, folder).withColumn("size", F.lit(1)), folder, "*").select("slide", F.spark_partition_id().alias("p"))
    tasks = {r.slide: r.n for r in d.groupBy("slide").agg(F.count_distinct("p").alias("n")).collect()}
    assert tasks["s9"] == tasks["s10"] == 1


ROWS = "slide string, n int, note string, " + sink.FILES


def rows_of(spark, n=12, parts=4):
    data = [(f"s{i}", i, None if i % 3 else 'say "x", then', [(f"a/{i}.bin", bytes([i] * 10)), (f"b/{i % 4}/{i}.bin", b"x" * i)] if i % 5 else []) for i in range(n)]
    return spark.createDataFrame(data, ROWS).repartition(parts, "n")


def everything(root):
    return {os.path.relpath(p, root): open(p, "rb").read() for p in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(p) and "manifest" not in os.path.relpath(p, root)}


def test_pictures_and_manifest_are_committed_together(spark, tmp_path):
    m = sink.write_pictures(rows_of(spark), str(tmp_path / "o"))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, rows_of(spark).drop("files").collect()))
    want = {f.path: bytes(f.data) for r in rows_of(spark).collect() for f in r.files}
    assert everything(f"{tmp_path}/o") == want and not glob.glob(f"{tmp_path}/o/_staging*")
    again = sink.write_pictures(rows_of(spark, parts=2), str(tmp_path / "o"))
    assert again.count() == 12 and everything(f"{tmp_path}/o") == want
    other = sink.write_pictures(rows_of(spark, 2), str(tmp_path / "o"), "manifest/b")
    assert other.count() == 2 and sink.write_pictures(rows_of(spark, 0), str(tmp_path / "empty")).count() == 0


def test_a_run_that_fails_half_way_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "o")
    bad = rows_of(spark).withColumn("n", F.when(F.col("n") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stop"):
        sink.write_pictures(bad, root)
    for _ in range(50):  # tasks that were running end at their next file
        if not glob.glob(f"{root}/_staging*"):
            break
        time.sleep(0.1)
    assert everything(root) == {} and not glob.glob(f"{root}/manifest/*") and not glob.glob(f"{root}/_staging*")
    assert sink.write_pictures(rows_of(spark), root).count() == 12 and len(everything(root)) == len([i for i in range(12) if i % 5]) * 2


def test_a_task_of_an_aborted_run_stops(spark, tmp_path):
    batches = rows_of(spark).coalesce(1).toArrow().to_batches(max_chunksize=5)
    w = sink._PictureWriter({"root": str(tmp_path / "o")}, rows_of(spark).columns, True)

    def slow():
        yield batches[0]
        w.abort([])
        yield from batches[1:]

    with pytest.raises(RuntimeError, match="aborted"):
        w.write_part(slow(), 0, f"{w.staging}/0-1")
    assert everything(f"{tmp_path}/o") == {} and not glob.glob(f"{tmp_path}/o/_staging*")


def test_lost_and_repeated_attempts_leave_one_manifest(spark, tmp_path):
    batches = rows_of(spark).coalesce(1).toArrow().to_batches(max_chunksize=5)
    w = sink._PictureWriter({"root": str(tmp_path / "o")}, rows_of(spark).columns, True)

    def broken():
        yield batches[0]
        raise OSError("lost")

    with pytest.raises(OSError):
        w.write_part(broken(), 0, f"{w.staging}/0-1")
    w.write_part(iter(batches), 0, f"{w.staging}/0-2")  # done, but its message was lost with the executor
    done = w.write_part(iter(batches), 0, f"{w.staging}/0-3")
    w.commit([done, None])
    parts = glob.glob(f"{tmp_path}/o/manifest/*.csv")
    assert len(parts) == 1 and len(spark.read.option("header", True).csv(f"{tmp_path}/o/manifest").collect()) == 12
    assert len(everything(f"{tmp_path}/o")) == done.files == 18 and not glob.glob(f"{tmp_path}/o/_staging*")
