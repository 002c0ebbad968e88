"""Slide files to tables, exports, streaming and the command line on small synthetic slides."""

import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.config import Config, Tiling, Tissue, TUNED
from tessera.export import files, pictures
from tessera.kernels import draw, figures
from tessera.operators import ensemble, tally
from tessera.plans import imaging
from tessera.sources import png
from tessera.sources import slides as src
from tessera.streaming import tally as stream

CFG = Config(tissue=Tissue(level=1, close_radius_um=0, open_radius_um=0, min_object_area_um2=0, max_hole_area_um2=3000, method="fixed"), tiling=Tiling(tile_size=128, stride=128), fat=TUNED.fat)


def disc(rgb, y, x, r, value=245):
    gy, gx = np.mgrid[: rgb.shape[0], : rgb.shape[1]]
    rgb[(gy - y) ** 2 + (gx - x) ** 2 <= r * r] = value


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("slides")
    for name, n in (("s10", 3), ("s9", 1)):
        rgb = np.full((256, 384, 3), 252, np.uint8)
        rgb[:, :256] = (190, 100, 150)
        for i in range(n):
            disc(rgb, 60, 40 + 70 * i, 14)
        (d / f"{name}.png").write_bytes(png.encode(rgb, 0.5))
    (d / "noscale.png").write_bytes(png.encode(np.zeros((200, 200, 3), np.uint8)))
    (d / "cut.png").write_bytes((d / "s9.png").read_bytes()[:300])
    (d / ".hidden.png").write_bytes(b"x")
    (d / "notes.txt").write_bytes(b"x")
    return str(d)


def test_png_round_trip():
    r = np.random.default_rng(1)
    for shape in ((1, 1), (5, 7), (6, 4, 3)):
        a = r.integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode(png.encode(a)) == a).all()
    assert png.header(png.encode(np.zeros((3, 5), np.uint8), 0.5))[:3] == (5, 3, 0.5)
    for bad in (b"", b"GIF89a", png.encode(np.zeros((3, 5), np.uint8))[:40]):
        with pytest.raises(Exception):
            png.decode(bad)


def test_discovery_and_metadata(spark, folder):
    assert [r.slide for r in src.find_slides(spark, folder).collect()] == ["cut", "noscale", "s9", "s10"]
    m = {r.slide: r for r in src.slides(spark, folder).collect()}
    assert m["s9"].mpp_x == 0.5 and m["s9"].width == 384 and len(m["s9"].levels) == 3 and m["s9"].error is None
    assert "scale" in m["noscale"].error and m["cut"].error
    src.register(spark)
    got = spark.read.format("slides").option("paths", f"{folder}/s9.png,{folder}/gone.png").load().collect()
    assert {r.slide: r.error is None for r in got} == {"s9": True, "gone": False}
    assert src.file_digests(spark, folder, "s*.png").count() == 2


def test_from_slides_to_summaries(spark, folder):
    meta, masks = src.slides(spark, folder, "s*.png"), imaging.tissue(spark, folder, CFG, "s*.png")
    grid = imaging.tiles(masks, meta, CFG)
    t = sorted((r.slide, r.x, r.y) for r in grid.collect())
    assert t == sorted((s, x, y) for s in ("s10", "s9") for x in (0, 128) for y in (0, 128))
    found = imaging.regions(spark, grid, folder, CFG, (200, 210), "s*.png").withColumn("tile", F.struct("x", "y"))
    one = found.where("white = 210")
    s = {r.slide: r for r in tally.slide_summary(one, imaging.tile_ground(grid), CFG.fat).collect()}
    assert s["s9"].macro_count == 1 and s["s10"].tiles == 4 and s["s10"].tissue_area_um2 == 256 * 256 * 0.25
    assert abs(s["s9"].macro_area_um2 - np.pi * 14**2 * 0.25) < 10
    v = imaging.votes(spark, grid, folder, ensemble.default_members(CFG.fat), "s*.png")
    assert all(0 < max(r.votes) <= 9 for r in v.where("x = 0 AND y = 0").collect())


def test_windows_hold_their_rows_only():
    r = np.random.default_rng(2)
    a = r.integers(0, 256, (90, 70, 3), dtype=np.uint8)
    s = src.RasterSlide(png.encode(a, 0.5))
    for x, y, n in ((0, 0, 20), (30, 10, 20), (5, 60, 40), (-5, 2, 12), (60, 80, 30)):
        want = np.zeros((n, n, 3), np.uint8)
        part = a[max(0, y) : y + n, max(0, x) : x + n]
        want[max(0, -y) : max(0, -y) + part.shape[0], max(0, -x) : max(0, -x) + part.shape[1]] = part
        assert (s.region(x, y, n) == want).all() and len(s._held) <= n
    assert (s.level(0) == a).all() and s.level(1).shape == (22, 17, 3) and s.thumbnail(35).shape == (35, 27, 3)
    assert (s.level(1)[3, 5] == a[12:16, 20:24].mean(axis=(0, 1)).round()).all()


def test_pyramid_files_go_through_the_reader(spark, monkeypatch, tmp_path):
    import sys
    import types

    class OpenSlide:
        dimensions, level_count, level_dimensions, level_downsamples = (400, 300), 2, ((400, 300), (100, 75)), (1.0, 4.0)
        properties = {"openslide.mpp-x": "0.5", "openslide.mpp-y": "0.25", "openslide.vendor": "v", "openslide.objective-power": "20"}

        def __init__(self, path):
            self.path = path

        def read_region(self, at, level, size):
            return np.full((size[1], size[0], 4), level + at[0], np.uint8)

    with pytest.raises(ValueError, match="no reader"):
        src.open_slide("file:/a/b.svs")
    monkeypatch.setitem(sys.modules, "openslide", types.SimpleNamespace(OpenSlide=OpenSlide))
    s = src.open_slide("file:/a/b%20c.svs")
    assert s._file.path == "/a/b c.svs" and (s.mpp_x, s.mpp_y, s.width) == (0.5, 0.25, 400)
    assert s.levels()[1] == (1, 100, 75, 4.0) and s.level(9).shape == (75, 100, 3) and (s.region(7, 0, 16) == 7).all()
    assert src.describe("b", "file:/a/b.svs")[6:8] == ("v", "20")


def test_unreadable_slides_leave_rows(spark, folder):
    rows = {r.slide: r for r in imaging.tissue(spark, folder, CFG).collect()}
    assert rows["cut"].error and rows["noscale"].error and rows["s9"].error is None


def test_exports(spark, folder, tmp_path):
    grid = imaging.tiles(imaging.tissue(spark, folder, CFG, "s*.png"), src.slides(spark, folder, "s*.png"), CFG)
    v = imaging.votes(spark, grid, folder, ensemble.default_members(CFG.fat), "s*.png").withColumns({"cohort": F.lit("positive"), "split": F.lit("train")})
    m = files.export_dataset(v, str(tmp_path)).collect()
    assert m == files.read_manifest(spark, f"{tmp_path}/manifest").collect() and all(r.tissue_fraction == 1 for r in m)
    assert len(m) == 8 and len(glob.glob(f"{tmp_path}/train/*/*.png")) == 24
    lab = png.decode(open(f"{tmp_path}/train/labels/{m[0].id}.png", "rb").read())
    assert int((lab > 127).sum()) == m[0].label_px
    a = files.export_annotations(spark, grid, folder, f"{tmp_path}/a", CFG.fat, "s*.png").collect()
    assert len(a) == 8 and sum(r.mask_is_prefilled for r in a) >= 2
    files.write_json(files.provenance(CFG, ["x"], src.file_digests(spark, folder, "s*.png")), f"{tmp_path}/p.json")
    p = json.load(open(f"{tmp_path}/p.json"))
    assert p["config_digest"] == CFG.digest() and len(p["inputs"]) == 2


def test_streaming_totals_equal_batch(spark, tmp_path):
    schema = "slide long, tile int, area_um2 double, circularity double, solidity double, eccentricity double, touches_border boolean, ts timestamp"
    d = spark.range(300).selectExpr("id % 5 AS slide", "CAST(id % 3 AS INT) AS tile", "CAST(id * 7 % 2500 AS DOUBLE) AS area_um2", "0.9D AS circularity", "0.9D AS solidity", "0.1D AS eccentricity", "id % 11 = 0 AS touches_border", "timestamp_seconds(id * 60) AS ts")
    d.repartition(6).write.parquet(f"{tmp_path}/in")
    s = stream.region_stream(spark, f"{tmp_path}/in", schema, 2)
    q = stream.running_tally(s, CFG.fat).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(map(tuple, stream.running_tally(d, CFG.fat).collect()))
    assert sorted(map(tuple, spark.table("totals").collect())) == want
    assert stream.windowed_tally(d, CFG.fat, "ts").agg(F.sum("macro_count")).first()[0] == sum(t[1] for t in want)
    stream.append_batches(stream.region_stream(spark, f"{tmp_path}/in", schema, 2), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/o").count() == 300 and len(glob.glob(f"{tmp_path}/o/batch=*")) >= 3


def test_tiles_that_are_sent_again_count_once(spark, tmp_path):
    """Files that come twice, corrected, late and empty, over restarts from the checkpoint: the totals are those of the latest versions."""
    r = np.random.default_rng(4)
    schema = "slide long, tile int, version long, label int, area_um2 double, circularity double, solidity double, eccentricity double, touches_border boolean"

    def file(slide, tile, version, n):
        rows = [(slide, tile, version, i, float(r.integers(1, 2500)), 0.9, float(r.choice([0.7, 0.95])), 0.1, bool(r.random() < 0.3)) for i in range(n)]
        return rows or [(slide, tile, version, 0, None, None, None, None, None)]

    one = {(s, t): file(s, t, 1, int(r.integers(0, 9))) for s in range(3) for t in range(6)}
    two = {(0, 0): file(0, 0, 2, 5), (0, 1): file(0, 1, 3, 0), (1, 2): file(1, 2, 2, 4)}
    rounds = [
        [*one.values(), one[0, 0]],  # the first file twice in one batch
        [one[1, 1], one[2, 5], *two.values()],  # sent again, and corrected
        [file(0, 1, 2, 7), one[0, 0], two[1, 2], file(1, 2, 3, 2)],  # late, old, again, corrected once more
    ]
    latest = one | two | {(1, 2): rounds[2][3]}
    for k, sent in enumerate(rounds):
        for i, rows in enumerate(sent):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        d = stream.replacing_tally(stream.region_stream(spark, f"{tmp_path}/in", schema, 100), CFG.fat)
        assert stream.append_batches(d, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
        if k == 0:
            assert spark.read.parquet(f"{tmp_path}/out").where("is_new").count() == 18
    seen = spark.read.option("mergeSchema", "false").parquet(f"{tmp_path}/out")
    got = {(x.slide, x.tile): tuple(x)[2:] for x in tally.merge(seen, ("slide", "tile")).collect()}
    flat = spark.createDataFrame([x for rows in latest.values() for x in rows if x[4] is not None], schema)
    want = {(x.slide, x.tile): tuple(x)[2:] for x in tally.merge(tally.tile_tally(flat, CFG.fat), ("slide", "tile")).collect()}
    assert got.keys() == latest.keys() and all(np.allclose(got[k], want.get(k, np.zeros(len(got[k])))) for k in got)
    assert seen.where("NOT is_new").count() == 4


def test_drawing():
    rgb, m = np.full((20, 20, 3), 100, np.uint8), np.zeros((20, 20), bool)
    m[5:15, 5:15] = True
    assert (draw.outline(rgb, m, thickness=1)[5, 5] == (255, 0, 0)).all() and (draw.outline(rgb, m, thickness=1)[10, 10] == 100).all()
    assert draw.shade(rgb, m, (200, 100, 0), 0.5)[10, 10].tolist() == [150, 100, 50]
    assert draw.two_class_rgb(m, np.ones_like(m))[10, 10].tolist() == [255, 0, 0]
    assert draw.contact_sheet([rgb] * 5, 2).shape == (68, 44, 3) and draw.mask_rgb(m).max() == 255
    assert draw.confidence_rgb(m * np.uint8(9), 9)[10, 10].tolist() == [255, 255, 0] and (draw.scale_bar(rgb, 1.0, 5)[-9, -9] == 0).all()


def test_figures():
    rgb, m = np.full((64, 64, 3), 100, np.uint8), np.zeros((64, 64), bool)
    m[10:30, 10:30] = True
    assert figures.lettering("I", 1).astype(int).tolist() == [[1, 1, 1], [0, 1, 0], [0, 1, 0], [0, 1, 0], [1, 1, 1]]
    assert figures.captioned(rgb, "a caption that is far too long for it").shape == (92, 64, 3) and figures.bar("", 3).shape == (28, 3, 3)
    assert figures.tile_caption({"macro": [25.0, 25.0]}, 1000.0) == "macro n=2 5.00% micro n=0 0.00%" and "0.00%" in figures.tile_caption({}, 0.0)
    f = figures.tile_figure(rgb, m, ~m)
    assert f.shape == (92, 3 * 64 + 12, 3) and (f[28 + 15, 64 + 6 + 15] == (255, 0, 0)).all()
    t = figures.tissue_figure(np.full((32, 48, 3), 90, np.uint8), m, caption="x")
    assert t.shape == (32 + 28 + 26, 3 * 48 + 24, 3) and (t[28 + 7, 48 + 12 + 10] == 255).all()
    assert figures.framed(rgb, 1.0).shape == (66, 66, 3) and (figures.framed(rgb, 2.0)[-12, -12] == 0).all()
    assert figures.label_note(m, 1.25) == "1.2% area, 1 droplets"
    page = figures.pdf(f)
    assert page.startswith(b"%PDF") and page[int(page.split(b"startxref\n")[1].split()[0]) :].startswith(b"xref")


def test_pictures_of_a_run_and_of_a_dataset(spark, folder, tmp_path):
    grid = imaging.tiles(imaging.tissue(spark, folder, CFG, "s*.png"), src.slides(spark, folder, "s*.png"), CFG)
    made = pictures.save_tiles(spark, pictures.chosen(grid, CFG), folder, CFG, f"{tmp_path}/p", "s*.png").collect()
    assert len(made) == 8 and all(r.error is None and r.qc for r in made) and len(glob.glob(f"{tmp_path}/p/*/*/*.png")) == 24
    top = next(r for r in made if (r.slide, r.x, r.y) == ("s9", 0, 0))
    assert (png.decode(open(top.tile, "rb").read())[60, 40] == 245).all() and png.decode(open(top.mask, "rb").read())[60, 40] == 255 and "macro n=1" in top.caption
    few = CFG.with_values({"tiling.save_tiles": False, "qc.contact_sheet_tiles": 1})
    assert [r.tile for r in pictures.save_tiles(spark, pictures.chosen(grid, few), folder, few, f"{tmp_path}/q", "s*.png").collect()] == [None, None]
    none = few.with_values({"qc.save_per_tile_qc": False})
    assert pictures.chosen(grid, none).count() == 0
    t = pictures.tissue_figures(spark, imaging.tissue(spark, folder, CFG), folder, CFG, f"{tmp_path}/t").collect()
    assert sorted(r.slide for r in t) == ["s10", "s9"] and len(glob.glob(f"{tmp_path}/t/*_tissue.png")) == 2

    v = imaging.votes(spark, grid, folder, ensemble.default_members(CFG.fat), "s*.png").withColumns({"cohort": F.lit("positive"), "split": F.lit("train")})
    m = files.export_dataset(v, str(tmp_path / "d"))
    gone = spark.createDataFrame([m.first().asDict() | {"id": "gone"}], m.schema)
    rows = pictures.label_pictures(spark, str(tmp_path / "d"), m.union(gone))
    assert rows.count() == 9 and [r.id for r in rows.where("images_path IS NULL").collect()] == ["gone"]
    best = rows.orderBy(F.desc("label_px")).first()
    image, label, confidence = pictures.load_label(best.asDict())
    assert image.shape == (128, 128, 3) and int(label.sum()) == best.label_px and int((confidence == 1).sum()) == best.unanimous_px
    out = pictures.dataset_figures(rows, {best.id: "most"}, 9, str(tmp_path / "f"))
    assert len(out) == 9 and all(open(p, "rb").read(4) in (b"%PDF", b"\x89PNG") for p in out)
    with pytest.raises(KeyError):
        pictures.dataset_figures(rows, {"gone": "x"}, 9, str(tmp_path / "f"))


def test_command_line(spark, folder, tmp_path, capsys):
    base = ["--group", f"a={folder}", "--set", "tiling.tile_size=128", "--set", "tiling.stride=128", "--set", "tissue.min_object_area_um2=0", "--set", "tissue.method=fixed", "--tiles", "3"]
    for command, extra in (("info", []), ("survey", []), ("run", []), ("sweep", ["--white-threshold", "200,210", "--group", f"b={folder}"])):
        assert cli.main([command, *base, *extra, "--out", f"{tmp_path}/{command}"]) == 0
    said = capsys.readouterr()
    assert said.out.index("a/s9 ") < said.out.index("a/s10 ") and "a/cut: open" in said.err
    assert len(glob.glob(f"{tmp_path}/run/pictures/a/*/masks/*.png")) == len(glob.glob(f"{tmp_path}/run/pictures/a/*/qc/*.png")) > 0
    assert cli.main(["batch", *base, "--no-save-tiles", "--contact-sheet-tiles", "1", "--out", f"{tmp_path}/batch"]) == 0
    assert not glob.glob(f"{tmp_path}/batch/pictures/a/*/tiles") and len(glob.glob(f"{tmp_path}/batch/pictures/a/*/qc/*.png")) == 2
    assert cli.main(["tissue", *base, "--out", f"{tmp_path}/tissue"]) == 0 and glob.glob(f"{tmp_path}/tissue/qc/a/*_tissue.png")
    assert cli.config_of(cli.parser().parse_args(["run", *base, "--exclude-border", "--tissue-level", "1", "--fat-method", "otsu"])).fat.exclude_border
    table = spark.read.option("header", True).csv(f"{tmp_path}/run/tiles_csv/a")
    assert len(table.columns) == 1 + 27 and {"tile_size", "tissue_fraction", "threshold", "macro_median_area_um2", "total_count", "rej_border"} < set(table.columns)
    assert {"tiles_candidate", "slide_tissue_area_mm2"} < set(spark.read.option("header", True).csv(f"{tmp_path}/run/run").columns)
    assert {"tissue_mm2", "components", "otsu"} < set(spark.read.option("header", True).csv(f"{tmp_path}/survey/survey").columns)
    assert glob.glob(f"{tmp_path}/run/tiles_csv/a/*.csv") and glob.glob(f"{tmp_path}/sweep/sweep_scored/*.csv")
    with pytest.raises(KeyError):
        cli.main(["info", *base, "--set", "fat.nope=1"])
    with pytest.raises(SystemExit):
        cli.groups(["x"])


def test_dataset_and_annotation_commands(spark, folder, tmp_path):
    base = ["--group", f"positive={folder}", "--set", "tiling.tile_size=128", "--set", "tiling.stride=128", "--set", "tissue.min_object_area_um2=0", "--set", "tissue.method=fixed", "--tiles", "3"]
    assert cli.main(["dataset", *base, "--out", f"{tmp_path}/d"]) == 0
    splits = json.load(open(f"{tmp_path}/d/splits.json"))["positive"]
    assert sorted(x for v in splits.values() for x in v) == ["s10", "s9"]
    bad = json.load(open(f"{tmp_path}/d/failures.json"))
    assert {(f["slide"], f["stage"]) for f in bad} == {(s, t) for s in ("cut", "noscale") for t in ("open", "tissue")}
    assert len(json.load(open(f"{tmp_path}/d/ensemble.json"))) == 9 and files.read_manifest(spark, f"{tmp_path}/d/manifest/positive").count() == 6
    assert cli.main(["annotate", *base, "--strata", "2", "--out", f"{tmp_path}/a"]) == 0
    m = spark.read.option("header", True).csv(f"{tmp_path}/a/annotate/manifest/positive")
    assert m.count() == 3 and len(m.columns) == 14 and glob.glob(f"{tmp_path}/a/annotate/README.md") and len(glob.glob(f"{tmp_path}/a/annotate/*/*.png")) == 9
    assert json.load(open(f"{tmp_path}/a/failures.json")) == bad


def test_panels(spark, folder):
    from tessera.plans import panels

    grid = imaging.tiles(imaging.tissue(spark, folder, CFG, "s*.png"), src.slides(spark, folder, "s*.png"), CFG)
    v = imaging.votes(spark, panels.quick_tiles(grid, 1).drop("population"), folder, ensemble.default_members(CFG.fat), "s*.png")
    counts = panels.tile_counts(v, min_px=100)
    sev = {r.slide: r.severity for r in panels.severity(counts).collect()}
    assert sev["s10"] > sev["s9"] > 0
    best = panels.best_panels(counts, 0.5, 20).collect()
    assert best and all(r.missed_blobs == 0 for r in best)
    why = {(r.verdict, r.in_label): r.n for r in panels.reason_counts(panels.region_reasons(v, CFG.fat), CFG.fat.min_area_um2).collect()}
    assert why[("macro", True)] >= 4 and ("macro", False) not in why
    sheets = panels.contact_sheets(v, CFG.fat, 4, 2).collect()
    assert {r.slide for r in sheets} == {"s9", "s10"} and png.decode(bytes(sheets[0].png)).shape[2] == 3
