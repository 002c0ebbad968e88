"""Masks labelled in bands equal the kernel on the whole mask."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.kernels import raster as K
from tessera.operators import bands as B
from tessera.operators.contract import stars


def masks():
    r = np.random.default_rng(7)
    out = [(r.random((h, w)) < p) for h, w, p in ((9, 12, 0.45), (9, 700, 0.6), (5, 3, 0.9), (12, 12, 0.2))]
    spiral = np.zeros((13, 13), bool)
    for k in range(0, 6, 2):
        spiral[k, k:13] = spiral[k : 13 - k, 12 - k] = spiral[12 - k, k : 13 - k] = spiral[k + 2 : 13 - k, k] = True
    return [*out, spiral, np.zeros((4, 4), bool), np.ones((6, 300), bool), np.eye(11, dtype=bool)]


def table(spark):
    rows = [(i, m.shape[0], m.shape[1], m.astype(np.uint8).tobytes()) for i, m in enumerate(masks())]
    return spark.createDataFrame(rows, "id int, h int, w int, data binary")


@pytest.mark.parametrize("height,corners", [(1, True), (2, False), (3, True), (5, True), (100, False)])
def test_labels_equal_the_kernel(spark, height, corners):
    cut = B.cut_bands(table(spark), height)
    labelled = B.part_labels(cut, corners)
    got = {}
    for r in B.painted(cut, labelled, corners).orderBy("id", "band").collect():
        got.setdefault(r.id, []).append(np.frombuffer(r.labels, np.int32).reshape(r.rows, r.w))
    for i, m in enumerate(masks()):
        assert (np.concatenate(got[i]) == K.label(m, corners)).all()
    want = {}
    for i, m in enumerate(masks()):
        lab = K.label(m, corners)
        for k in range(1, int(lab.max()) + 1):
            y, x = np.nonzero(lab == k)
            want[i, k] = (len(y), x.mean(), y.mean(), x.min(), y.min(), x.max(), y.max())
    rows = {(r.id, r.label): tuple(r)[2:] for r in B.regions(labelled).collect()}
    assert rows.keys() == want.keys() and all(np.allclose(rows[k], want[k]) for k in want)


def test_small_and_largest_regions(spark):
    cut = B.cut_bands(table(spark), 3)
    labelled = B.part_labels(cut, True)
    kept = B.painted(cut, B.large_enough(labelled, 4)).where("id = 0").orderBy("band").collect()
    whole = np.concatenate([np.frombuffer(r.labels, np.int32).reshape(r.rows, r.w) for r in kept])
    assert ((whole > 0) == K.without_small(masks()[0], 4, corners=True)).all()
    sizes = sorted((-r.area_px, r.label) for r in B.regions(labelled).where("id = 3").collect())
    got = {r.label for r in B.large_enough(labelled, 0, 2).where("id = 3").collect()}
    assert got == {k for _, k in sizes[:2]}


def test_components_of_pairs(spark):
    chain = [(0, i, i + 1) for i in range(200)] + [(1, i, i + 1) for i in range(0, 20, 2)] + [(1, 5, 5), (2, 9, 3), (2, 3, 7), (2, 7, 9), (2, 7, 9)]
    got = {(r.k, r.node): r.root for r in stars(spark.createDataFrame(chain, "k int, u long, v long"), ["k"]).collect()}
    want = {(0, i): 0 for i in range(201)} | {(1, i): i // 2 * 2 for i in range(20)} | {(2, i): 3 for i in (3, 7, 9)}
    assert got == want
    hot = spark.range(1, 3000).select(F.lit(0).alias("k"), F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    assert stars(hot, ["k"]).where("root = 0").count() == 3000 and stars(hot.limit(0), ["k"]).count() == 0


def test_a_mask_that_no_task_holds(spark):
    """20,000 x 20,000 pixels in bands of 250 rows, each made where it is labelled: stripes down the mask, some cut, and a frame around."""
    side, height = 20_000, 250

    def one(it):
        import pyarrow as pa

        for b in it:
            for n in b.column(0).to_pylist():
                m = np.zeros((height, side), bool)
                m[:, 50::400] = m[:, 51::400] = True
                y = np.arange(n * height, (n + 1) * height)
                m[(y >= 10_000) & (y < 10_010), 50 : side // 2] = False
                m[:, 0] = m[:, -1] = True
                m[y == 0] = m[y == side - 1] = False
                m[(y == 0) | (y == side - 1), 0:10] = True
                yield pa.RecordBatch.from_pylist([{"id": 1, "band": n, "y0": n * height, "rows": height, "w": side, "bits": np.packbits(m).tobytes()}], pa.schema([*((c, pa.int32()) for c in ("id", "band", "y0", "rows", "w")), ("bits", pa.binary())]))

    cut = spark.range(side // height).repartition(8).mapInArrow(one, "id int, band int, y0 int, rows int, w int, bits binary")
    got = B.regions(B.part_labels(cut)).collect()
    stripes = len(range(50, side, 400))
    left = len(range(50, side // 2, 400))
    assert len(got) == stripes + left + 2 and sum(r.area_px for r in got if r.max_x - r.min_x == 1) == 2 * (stripes * (side - 2) - left * 10)
    assert {r.max_y - r.min_y for r in got if r.min_x > 50 and r.max_x < side // 2} == {9998, 9988}
