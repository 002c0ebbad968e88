"""Pyramid files read by offset: against whole pictures, in bytes, and as tables."""

import numpy as np
import pytest

from tessera.sources import tiff
from tessera.sources.stores import Ranges, digest


def levels(seed=1, h=300, w=410, channels=3):
    r = np.random.default_rng(seed)
    a = r.integers(0, 256, (h, w, channels) if channels > 1 else (h, w), dtype=np.uint8)
    return [a, a[::4, ::4], a[::16, ::16]]


def as_rgb(a):
    a = a.reshape(a.shape[0], a.shape[1], -1)
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]


def cut(a, x, y, w, h):
    out = np.zeros((h, w, 3), np.uint8)
    part = as_rgb(a)[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    out[max(0, -y) : max(0, -y) + part.shape[0], max(0, -x) : max(0, -x) + part.shape[1]] = part
    return out


KINDS = [
    dict(compression=1), dict(), dict(big=True), dict(compression=1, big=True, order=">"), dict(order=">"), dict(predictor=2), dict(tile=None), dict(tile=None, compression=1),
    dict(tile=(48, 16), compression=32946), dict(tile=(1024, 512)),
]


@pytest.mark.parametrize("channels", [1, 3, 4])
@pytest.mark.parametrize("kind", range(len(KINDS)))
def test_windows_equal_a_whole_decode(tmp_path, kind, channels):
    pages = levels(kind, channels=channels)
    p = str(tmp_path / "a.tif")
    with open(p, "wb") as f:
        f.write(tiff.encode(pages, **({"tile": (64, 32)} | KINDS[kind]), mpp=0.5))
    s = tiff.TiffSlide(p)
    assert (s.width, s.height) == (410, 300) and abs(s.mpp_x - 0.5) < 1e-9 and [x[1:3] for x in s.levels()] == [(410, 300), (103, 75), (26, 19)]
    for k, a in enumerate(pages):
        assert (s.level(k) == as_rgb(a)).all()
    for k, x, y, w, h in ((0, 0, 0, 64, 32), (0, 63, 31, 2, 2), (0, 380, 280, 60, 60), (0, -20, -10, 50, 50), (1, 10, 10, 90, 60), (0, 500, 0, 8, 8), (0, -50, 40, 20, 20), (7, 0, 0, 26, 19)):
        assert (s.window(k, x, y, w, h) == cut(pages[min(k, 2)], x, y, w, h)).all()
    assert (s.region(100, 50, 77) == cut(pages[0], 100, 50, 77, 77)).all()
    t = s.thumbnail(100)
    assert t.shape == (73, 100, 3) and (t[0, 0] == as_rgb(pages[1])[0, 0]).all() and s.thumbnail(9999).shape == (300, 410, 3)
    with pytest.raises(ValueError):
        s.level(-1)


def test_a_window_costs_its_own_tiles(tmp_path, monkeypatch):
    a = levels(3, 2048, 2048)[0]
    p = str(tmp_path / "a.tif")
    with open(p, "wb") as f:
        f.write(tiff.encode([a], (256, 256), compression=1, mpp=0.25))
    s = tiff.TiffSlide(p)
    head = s.source.bytes_read
    assert head < 4096
    tile = 256 * 256 * 3
    s.region(1700, 1700, 64)
    assert s.source.bytes_read - head == tile  # inside one tile, far down the file
    s.region(1710, 1710, 64)
    assert s.source.bytes_read - head == tile  # kept
    s.region(200, 200, 100)
    assert s.source.bytes_read - head == 5 * tile  # over a corner of four
    monkeypatch.setattr(tiff, "KEPT", tile)
    s.region(0, 0, 2048)
    assert len(s._kept) <= 1


def test_ranges_are_read_in_order_and_together(tmp_path):
    p = str(tmp_path / "x")
    data = bytes(range(256)) * 400
    with open(p, "wb") as f:
        f.write(data)
    r = Ranges(p)
    want = [(90_000, 10), (5, 3), (8, 4), (70_000, 1)]
    assert r.fetch(want) == {(a, n): data[a : a + n] for a, n in want}
    assert r.bytes_read < 30 + 2 * tiff.struct.calcsize("Q") + 20_011
    with pytest.raises(ValueError, match="ends early"):
        r.read(len(data) - 2, 3)
    import hashlib

    assert digest(p) == hashlib.sha256(data).hexdigest() and digest("file:" + p) == digest(p)


def test_files_that_cannot_be_read(tmp_path):
    page = levels()[0]

    def error(data):
        p = str(tmp_path / "bad.tif")
        with open(p, "wb") as f:
            f.write(data)
        with pytest.raises(ValueError) as e:
            tiff.TiffSlide(p)
        return str(e.value)

    good = tiff.encode([page], (64, 64), mpp=0.5)
    assert "physical scale" in error(tiff.encode([page], (64, 64)))
    assert "compression 7 (JPEG) is not read" in error(tiff.encode([page], (64, 64), compression=7, mpp=0.5))
    assert "compression 5 (LZW)" in error(tiff.encode([page], (64, 64), compression=5, mpp=0.5))
    assert "not a TIFF" in error(b"GIF89a and so on") and "not a TIFF" in error(b"II") and "not a TIFF" in error(b"")
    assert "ends early" in error(good[:-200])
    at = tiff.struct.unpack("<I", good[4:8])[0]
    round_ = bytearray(good)
    tiff.struct.pack_into("<I", round_, len(good) - 4, at)
    assert "circle" in error(bytes(round_))


def test_labels_and_thumbnails_are_not_levels(tmp_path):
    a, b, _ = levels()
    tiled = tiff.encode([a, b], (64, 64), mpp=0.5, text="Scanner |MPP = 0.2520|AppMag = 40")
    p = str(tmp_path / "a.svs")
    with open(p, "wb") as f:
        f.write(tiled)
    found = tiff.directories(Ranges(p))
    assert found[0].mpp_x == 0.252 and len(tiff.pyramid(found)) == 2 and tiff.TiffSlide(p).objective == "40"
    thumb = tiff.Directory(410, 300, 410, 16, False, np.zeros(19, int), np.zeros(19, int))
    label = tiff.Directory(300, 300, 64, 64, True, np.zeros(25, int), np.zeros(25, int))
    assert tiff.pyramid([found[0], thumb, found[1], label]) == [found[0], found[1]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pyramids")
    for name, kind in (("s10", {}), ("s9", dict(compression=1, big=True)), ("strips", dict(tile=None)), ("photo", dict(compression=7))):
        with open(d / f"{name}.tif", "wb") as f:
            f.write(tiff.encode(levels(len(name)), **({"tile": (64, 32), "mpp": 0.5} | kind)))
    (d / "cut.tif").write_bytes((d / "s9.tif").read_bytes()[:200])
    (d / "notes.txt").write_bytes(b"x")
    return str(d)


def test_tile_table_and_windows_of_many_slides(spark, folder):
    from tessera.sources import slides as src

    index = src.tile_index(spark, folder)
    rows = index.groupBy("slide", "level").count().collect()
    assert {(r.slide, r.level): r["count"] for r in rows if r.slide in ("s9", "s10")} == {(s, k): n for s in ("s9", "s10") for k, n in ((0, 70), (1, 6), (2, 1))}
    bad = {(r.slide, r.level): r.error for r in index.where("error IS NOT NULL").collect()}
    assert set(bad) == {("photo", 0), ("photo", 1), ("photo", 2), ("cut", None)} and "JPEG" in bad["photo", 0]
    want = [(s, k, x, y, w, h) for s in ("s9", "s10", "strips") for k, x, y, w, h in ((0, 0, 0, 64, 32), (0, 60, 30, 70, 70), (0, -9, -9, 30, 30), (0, 400, 290, 50, 50), (1, 3, 3, 99, 70), (0, 900, 0, 5, 5))]
    want += [("photo", 0, 0, 0, 9, 9), ("s9", 9, 0, 0, 9, 9), ("none", 0, 0, 0, 9, 9), ("s9", 0, 0, 0, 64, 32)]
    got = src.read_windows(spark.createDataFrame(want, "slide string, level int, x int, y int, w int, h int"), index).collect()
    assert len(got) == len(set(want))
    for r in got:
        if r.slide in ("photo", "none") or r.level == 9:
            assert r.error and r.pixels is None
            continue
        assert r.error is None
        a = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w, 3)
        assert (a == cut(levels(len(r.slide))[r.level], r.x, r.y, r.w, r.h)).all()
        if r.slide == "s9" and (r.x, r.y, r.level) == (0, 0, 0):
            assert r.bytes_read == 64 * 32 * 3
    plan = src.read_windows(spark.createDataFrame(want, "slide string, level int, x int, y int, w int, h int"), index)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_source(spark, folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from tessera.sources import slides as src
    from tessera.sources import stores

    opened = []
    real = stores.open_input
    monkeypatch.setattr(stores, "open_input", lambda p: opened.append(p) or real(p))
    read = lambda r: [x for p in r.partitions() for x in r.read(p)]
    r = src.SlideSource({"folder": folder}).reader(None)
    assert len(r.partitions()) == 5 and list(r.pushFilters([EqualTo(("slide",), "s9"), GreaterThan(("width",), 3)])) == [GreaterThan(("width",), 3)]
    assert [x[0] for x in read(r)] == ["s9"] and opened == [f"{folder}/s9.tif"]
    opened.clear()
    r = src.SlideSource({"folder": folder, "pattern": "s*.tif", "table": "tiles"}).reader(None)
    list(r.pushFilters([In(("slide",), ("s10", "photo")), In(("level",), (1, 2))]))
    assert sum(b.num_rows for b in read(r)) == 7 and opened == [f"{folder}/s10.tif"]

    src.register(spark)
    d = spark.read.format("slides").option("folder", folder).load()
    assert [x.slide for x in d.collect()] == ["cut", "photo", "s9", "s10", "strips"]
    one = d.where("slide = 's9' AND width > 3")
    assert one.rdd.getNumPartitions() == 1 and [(x.slide, x.width, x.vendor) for x in one.collect()] == [("s9", 410, "tiff")]
    t = spark.read.format("slides").option("folder", folder).option("table", "tiles").load().where("slide IN ('s9', 's10') AND level = 1")
    assert t.rdd.getNumPartitions() == 2 and t.count() == 12
    assert d.where("slide = 'gone'").count() == 0
