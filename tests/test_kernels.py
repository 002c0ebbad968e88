"""Kernels on hand-drawn rasters, against direct definitions."""

from dataclasses import replace

import numpy as np
import pytest

from tessera.config import Fat, Tissue
from tessera.kernels import raster as K


def disc(n, cy, cx, r):
    y, x = np.mgrid[:n, :n]
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


def plain_spread(m, r):
    out = np.zeros_like(m)
    h, w = m.shape
    for y, x in zip(*np.nonzero(m), strict=True):
        for dy, dx in K.disk(r):
            if 0 <= y + dy < h and 0 <= x + dx < w:
                out[y + dy, x + dx] = True
    return out


def plain_label(m, corners):
    lab, n = np.zeros(m.shape, int), 0
    near = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    for y, x in zip(*np.nonzero(m), strict=True):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in near:
                c, d = a + dy, b + dx
                if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and not lab[c, d]:
                    lab[c, d] = n
                    todo.append((c, d))
    return lab


def test_morphology_and_labels_match_definitions():
    r = np.random.default_rng(1)
    for _ in range(30):
        m = r.random((r.integers(1, 20), r.integers(1, 20))) < r.choice([0.2, 0.5, 0.8])
        for k in (0, 1, 2, 3):
            if k:
                assert (K.dilate(m, k) == plain_spread(m, k)).all()
            assert (K.erode(m, k) == ~K.dilate(~m, k)).all()
        for corners in (False, True):
            assert (K.label(m, corners) == plain_label(m, corners)).all()
    two = np.array([[1, 0], [0, 1]], bool)
    assert K.label(two).max() == 1 and K.label(two, corners=False).max() == 2


def test_shapes():
    d = K.regions(K.label(disc(41, 20, 20, 12)))[0]
    assert d.circularity > 0.9 and d.solidity > 0.92 and d.eccentricity < 0.05 and not d.touches_border
    assert (d.centroid_x, d.centroid_y) == (20, 20) and d.area_px == disc(41, 20, 20, 12).sum()
    y, x = np.mgrid[:61, :61]
    e = K.regions(K.label(((y - 30) / 10) ** 2 + ((x - 30) / 25) ** 2 <= 1))[0]
    assert e.circularity > 0.65 and abs(e.eccentricity - np.sqrt(1 - 0.16)) < 0.02
    cut = K.regions(K.label(disc(41, 0, 20, 8)))[0]
    assert cut.touches_border
    ring = disc(41, 20, 20, 12) & ~disc(41, 20, 20, 5)
    assert (K.filled(ring) == disc(41, 20, 20, 12)).all()
    bridge = disc(61, 30, 18, 9) | disc(61, 30, 42, 9)
    bridge[30, 18:43] = True
    assert K.label(bridge).max() == 1 and K.label(K.opened(bridge, 2)).max() == 2
    assert K.perimeter(np.ones((5, 5), bool)) == 16.0 and K.regions(K.label(np.ones((1, 1), bool)))[0].circularity == 0.0
    square = K.regions(K.label(np.pad(np.ones((6, 6), bool), 2)))[0]
    assert square.solidity == 1.0 and square.eccentricity == 0.0


def test_otsu_and_colour():
    g = np.array([[10] * 50 + [200] * 30], np.uint8)
    assert K.otsu(g) == 10 and K.otsu(np.full((3, 3), 7, np.uint8)) == 7
    rgb = np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0], [200, 100, 50]]], np.uint8)
    s, v = K.saturation_value(rgb)
    assert s.tolist() == [[0, 0, 255, 191]] and v.tolist() == [[255, 0, 255, 200]]
    assert K.gray(rgb).tolist() == [[255, 0, 76, 124]]


def slide(n=256, discs=((60, 60, 12), (60, 150, 10), (170, 100, 14), (200, 200, 3))):
    rgb = np.full((n, n, 3), (190, 110, 160), np.uint8)
    for y, x, r in discs:
        rgb[disc(n, y, x, r)] = 245
    return rgb


def test_tile_pipeline_finds_the_discs():
    rgb, all_ = slide(), np.ones((256, 256), bool)
    cfg = Fat(white_threshold=210, min_area_um2=40.0)
    lab, t = K.segment(rgb, all_, cfg)
    found = K.regions(lab)
    assert t == 210 and len(found) == 4
    assert [K.judge(r, 0.25, cfg) for r in sorted(found, key=lambda r: -r.area_px)] == ["macro"] * 3 + ["micro"]
    none, _ = K.segment(rgb, np.zeros((256, 256), bool), cfg)
    assert none.max() == 0
    with pytest.raises(ValueError):
        K.segment(rgb, all_, Fat(method="nope"))
    flat, t = K.segment(np.full((8, 8, 3), 90, np.uint8), np.ones((8, 8), bool), Fat(method="otsu", white_threshold=200))
    assert flat.max() == 0 and t == 200
    votes, pct = K.votes(rgb, all_, [("a", cfg), ("b", Fat(white_threshold=210, min_area_um2=100.0)), ("c", Fat(white_threshold=250))], 0.25)
    assert votes.max() == 2 and pct["a"] >= pct["b"] > pct["c"] == 0.0


def test_votes_equal_the_relational_form(spark):
    from tessera.operators import classify, ensemble

    r = np.random.default_rng(4)
    rgb = np.full((160, 160, 3), (190, 110, 160), np.uint8)
    y, x = np.mgrid[:160, :160]
    for _ in range(14):
        cy, cx, ry, rx = *r.integers(0, 160, 2), *r.integers(4, 16, 2)
        rgb[((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 <= 1] = r.choice([205, 215, 245])
    members = [(n, replace(m, exclude_border=i % 2 == 0, include_microvesicular=i % 3 == 0)) for i, (n, m) in enumerate(ensemble.default_members(Fat(circularity_min=0.5)))]
    ground = np.ones((160, 160), bool)
    v, pct = K.votes(rgb, ground, members, 0.25)
    rows, pictures = [], {}
    for w in sorted({m.white_threshold for _, m in members}):
        pictures[w], _ = K.segment(rgb, ground, replace(members[0][1], white_threshold=w))
        rows += [(1, w, g.label, g.area_px * 0.25, g.circularity, g.solidity, g.eccentricity, bool(g.touches_border)) for g in K.regions(pictures[w])]
    d = spark.createDataFrame(rows, "slide long, white int, label int, area_um2 double, circularity double, solidity double, eccentricity double, touches_border boolean")
    table = classify.parameter_table(spark, members)
    want = np.zeros((160, 160), int)
    for row in ensemble.region_votes(d, table, ["white", "label"]).collect():
        want[pictures[row.white] == row.label] += row.votes
    assert (v == want).all() and v.max() > 2
    tiles = spark.createDataFrame([(1, 160 * 160 * 0.25)], "slide long, tissue_area_um2 double")
    share = {x.name: x.pct for x in ensemble.member_pct(d, tiles, table).collect()}
    assert all(abs(share[n] - pct[n]) < 1e-9 for n in share) and set(share) == set(pct)


def test_tissue():
    rgb = np.full((120, 120, 3), 250, np.uint8)
    rgb[20:90, 30:100] = (190, 90, 150)
    rgb[40:44, 50:54] = 250
    rgb[5:7, 5:7] = (190, 90, 150)
    m, _ = K.detect_tissue(rgb, 8.0, 64.0, Tissue(close_radius_um=8, open_radius_um=8, min_object_area_um2=5000, max_hole_area_um2=20000))
    assert m.sum() > 4800 and not m[:10, :10].any() and m[42, 52]
    f = K.tissue_fractions(m, np.array([[30 * 4, 20 * 4, 280, 280], [0, 0, 40, 40], [5000, 0, 10, 10]]), 4.0)
    assert f[0] > 0.95 and f[1] == 0 and f[2] == 0
    assert K.tile_mask(m, 160, 160, 64, 64, 4.0).all() and not K.tile_mask(m, 0, 0, 16, 16, 4.0).any()
    assert K.keep_largest(np.array([[1, 0, 1, 1]], bool), 1).tolist() == [[False, False, True, True]]
