"""SQL for the named queries, for an engine that has only the driver's tables. Written from the semantics, not generated from the plans."""

from __future__ import annotations

from tessera.sources.fixtures import COMPONENTS, SLIDES

PARAMS = "40.0 AS min_area_um2, 2000.0 AS max_area_um2, 0.55 AS circularity_min, 0.85 AS solidity_min, 0.80 AS max_eccentricity, 3.0 AS micro_min_area_um2, 0.5 AS micro_circularity_min, 0.8 AS micro_solidity_min"
PARAMS = ", ".join(f"CAST({x.split(' AS ')[0]} AS DOUBLE) AS {x.split(' AS ')[1]}" for x in PARAMS.split(", "))
VERDICT = """CASE WHEN area_um2 >= min_area_um2 AND area_um2 <= max_area_um2 THEN
      CASE WHEN circularity < circularity_min THEN 'low_circularity' WHEN solidity < solidity_min THEN 'low_solidity' WHEN NOT isnan(eccentricity) AND eccentricity > max_eccentricity THEN 'elongated' ELSE 'macro' END
    WHEN area_um2 >= micro_min_area_um2 AND area_um2 < min_area_um2 THEN
      CASE WHEN circularity < micro_circularity_min THEN 'low_circularity' WHEN solidity < micro_solidity_min THEN 'low_solidity' ELSE 'micro' END
    WHEN area_um2 > max_area_um2 THEN 'too_large' ELSE 'too_small' END"""
REASONS = ("too_small", "too_large", "low_circularity", "low_solidity", "elongated")


def _tally(out: str = "false") -> str:
    ok, take = "verdict IN ('macro', 'micro')", f"NOT (touches_border AND {out})"
    cols = [f"count(*) FILTER (WHERE verdict = '{k}' AND {take}) AS {k}_count, coalesce(sum(area_um2) FILTER (WHERE verdict = '{k}' AND {take}), 0.0) AS {k}_area_um2" for k in ("macro", "micro")]
    cols += [f"count(*) FILTER (WHERE {ok} AND touches_border) AS border_count, coalesce(sum(area_um2) FILTER (WHERE {ok} AND touches_border), 0.0) AS border_area_um2"]
    cols += [f"count(*) FILTER (WHERE verdict = '{r}') AS rej_{r}" for r in REASONS] + [f"count(*) FILTER (WHERE {ok} AND touches_border AND {out}) AS rej_border"]
    return ", ".join(cols)


SUMS = ["macro_count", "micro_count", "macro_area_um2", "micro_area_um2", "border_count", "border_area_um2", *[f"rej_{r}" for r in (*REASONS, "border")]]
ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in SUMS)
BASE = f"""
components AS ({COMPONENTS}), params AS (SELECT {PARAMS}), slides AS ({SLIDES}),
tiles AS (SELECT s_suppkey AS slide, CAST(t AS INT) AS tile, CAST(t % 4 * 512 AS INT) AS x, CAST(t // 4 * 512 AS INT) AS y, 50000.0::DOUBLE + t * 1000 AS tissue_area_um2 FROM supplier, unnest(range(16)) AS r(t)),
judged AS (SELECT components.*, {VERDICT} AS verdict FROM components, params),
tally AS (SELECT slide, tile, {_tally()} FROM judged GROUP BY slide, tile),
ground AS (SELECT slide, count(*) AS tiles, sum(tissue_area_um2) AS tissue_area_um2 FROM tiles GROUP BY slide),
found AS (SELECT slide, {_tally()} FROM judged GROUP BY slide),
summary AS (
  SELECT slide, tiles, tissue_area_um2, {ZERO}, coalesce(macro_area_um2, 0) / tissue_area_um2 AS macro_fraction, coalesce(micro_area_um2, 0) / tissue_area_um2 AS micro_fraction,
    (coalesce(macro_area_um2, 0) + coalesce(micro_area_um2, 0)) / tissue_area_um2 AS total_fraction,
    CASE WHEN coalesce(macro_area_um2, 0) + coalesce(micro_area_um2, 0) > 0 THEN border_area_um2 / (macro_area_um2 + micro_area_um2) ELSE 0.0 END AS border_share
  FROM ground LEFT JOIN found USING (slide)
)"""
#: Sampled tiles and the survey over them.
SURVEY = """, numbered AS (SELECT *, count(*) OVER (PARTITION BY slide) AS population, row_number() OVER (PARTITION BY slide ORDER BY md5('7|' || slide || '|' || x || '|' || y), x, y) AS draw FROM tiles),
drawn AS (SELECT * FROM numbered WHERE draw <= 6),
s_ground AS (SELECT slide, count(*) AS sampled, max(population) AS cand_tiles, sum(tissue_area_um2) AS tissue FROM drawn GROUP BY slide),
s_tally AS (SELECT slide, CAST(sum(macro_count) AS BIGINT) AS mn, CAST(sum(micro_count) AS BIGINT) AS un, sum(macro_area_um2) AS ma, sum(micro_area_um2) AS ua, sum(border_area_um2) AS ba FROM tally JOIN drawn USING (slide, tile) GROUP BY slide),
s AS (SELECT slide, cand_tiles, sampled, tissue, coalesce(mn, 0) AS mn, coalesce(un, 0) AS un, coalesce(ma, 0) AS ma, coalesce(ua, 0) AS ua, coalesce(ba, 0) AS ba FROM s_ground LEFT JOIN s_tally USING (slide)),
survey AS (
  SELECT slide, cand_tiles, sampled, round(tissue / 1e6, 9) AS sampled_tissue_mm2, round(ma / tissue * 100, 9) AS macro_pct, round(ua / tissue * 100, 9) AS micro_pct, round((ma + ua) / tissue * 100, 9) AS total_pct, mn AS macro_n, un AS micro_n,
    round(mn / sampled, 9) AS macro_n_per_tile, round(un / sampled, 9) AS micro_n_per_tile, round(CASE WHEN mn > 0 THEN ma / mn ELSE 0 END, 9) AS macro_mean_um2, round(CASE WHEN ma + ua > 0 THEN ba / (ma + ua) * 100 ELSE 0 END, 9) AS border_pct_of_fat
  FROM s)"""
KEYS = "white, circularity_min, min_area_um2, max_eccentricity"
SWEEP = f""", grid AS (
  SELECT CAST(row_number() OVER (ORDER BY w, c, a, e) - 1 AS INT) AS cell, w AS white, c AS circularity_min, a AS min_area_um2, e AS max_eccentricity
  FROM (VALUES (200), (210), (220)) w(w), (VALUES (0.55::DOUBLE), (0.65::DOUBLE)) c(c), (VALUES (20.0::DOUBLE), (40.0::DOUBLE), (60.0::DOUBLE)) a(a), (VALUES (0.75::DOUBLE), (0.8::DOUBLE)) e(e)
), swept AS (
  SELECT slide, cell, {_tally()} FROM (
    SELECT c.slide, g.cell, c.area_um2, c.touches_border, {VERDICT} AS verdict FROM components c JOIN grid g USING (white), (SELECT max_area_um2, solidity_min, micro_min_area_um2, micro_circularity_min, micro_solidity_min FROM params)
  ) GROUP BY slide, cell
), sweep AS (
  SELECT slide, {KEYS}, tiles, coalesce(macro_area_um2, 0) / tissue_area_um2 * 100 AS macro_pct, coalesce(micro_area_um2, 0) / tissue_area_um2 * 100 AS micro_pct, coalesce(macro_count, 0) AS macro_n, cohort AS "group"
  FROM ground CROSS JOIN grid LEFT JOIN swept USING (slide, cell) JOIN slides USING (slide)
)"""
SEPARATE = 'avg(macro_pct) FILTER (WHERE "group" = \'positive\') AS pos_mean, min(macro_pct) FILTER (WHERE "group" = \'positive\') AS pos_min, avg(macro_pct) FILTER (WHERE "group" = \'negative\') AS neg_mean, max(macro_pct) FILTER (WHERE "group" = \'negative\') AS neg_max'


def _auc(rows: str, keys: str, value: str = "macro_pct") -> str:
    """Mann-Whitney from mid-ranks."""
    return f"""SELECT {keys}, (sum(r) FILTER (WHERE "group" = 'positive') - count(*) FILTER (WHERE "group" = 'positive') * (count(*) FILTER (WHERE "group" = 'positive') + 1) / 2.0)
      / nullif(count(*) FILTER (WHERE "group" = 'positive') * count(*) FILTER (WHERE "group" = 'negative'), 0) AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0 AS r FROM {rows}) GROUP BY {keys}"""


HOLD = f""", sw AS (SELECT slide, "group", {KEYS}, round(macro_pct, 6) AS macro_pct FROM sweep),
pick AS (SELECT rep, slide, row_number() OVER (PARTITION BY rep, cohort ORDER BY md5('7|' || rep || '|' || slide), slide) <= greatest(2, CAST(round_even(n * 0.3, 0) AS INT)) AS is_test
  FROM (SELECT *, count(*) OVER (PARTITION BY cohort) AS n FROM slides) q, unnest(range(300)) AS r(rep)),
sides AS (SELECT sw.*, CAST(rep AS INT) AS rep, is_test FROM sw JOIN pick USING (slide)),
tuned AS (SELECT rep, {KEYS}, min(macro_pct) FILTER (WHERE "group" = 'positive') - max(macro_pct) FILTER (WHERE "group" = 'negative') AS tune_metric FROM sides WHERE NOT is_test GROUP BY rep, {KEYS}),
best AS (SELECT * FROM tuned WHERE tune_metric IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rep ORDER BY tune_metric DESC, {KEYS}) = 1),
test AS (SELECT sides.* FROM sides JOIN best USING (rep, {KEYS}) WHERE is_test),
tested AS (SELECT rep, {SEPARATE} FROM test GROUP BY rep), tested_auc AS ({_auc("test", "rep")}),
hold AS (
  SELECT rep, {KEYS}, tune_metric, pos_min - neg_max AS test_metric, auc AS test_auc, pos_mean AS test_pos_mean, neg_mean AS test_neg_mean FROM best JOIN tested USING (rep) LEFT JOIN tested_auc USING (rep))"""
PIXELS = """
e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT vec_id AS id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) + CAST(0.55 AS DOUBLE)) * 232) AS INT))) AS INT) AS gray FROM e),
fg AS (SELECT id, y, x FROM px WHERE gray >= 140),
cross5(dy, dx) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)),
near8(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1))"""
#: Regions by a recursive flood: each pixel's least reachable pixel.
FLOOD = """,
reach(id, y, x, o) AS (SELECT id, y, x, y * 8 + x FROM fg UNION SELECT fg.id, fg.y, fg.x, reach.o FROM reach, near8, fg WHERE fg.id = reach.id AND fg.y = reach.y + dy AND fg.x = reach.x + dx),
root AS (SELECT id, y, x, min(o) AS o FROM reach GROUP BY id, y, x),
lab AS (SELECT id, y, x, CAST(dense_rank() OVER (PARTITION BY id ORDER BY o) AS INT) AS label FROM root),
reg AS (SELECT id, label, count(*) AS area_px FROM lab GROUP BY id, label)"""


def _step(name: str, source: str, kind: str) -> str:
    """Erosion or dilation with the five-pixel cross; what lies outside the raster takes no part."""
    hit = f"(SELECT px.id, px.y, px.x, bool_{'and' if kind == 'erode' else 'or'}(s.id IS NOT NULL) AS hit FROM px CROSS JOIN cross5 JOIN px q ON q.id = px.id AND q.y = px.y + dy AND q.x = px.x + dx LEFT JOIN {source} s ON s.id = q.id AND s.y = q.y AND s.x = q.x GROUP BY px.id, px.y, px.x)"
    return f"{name} AS (SELECT id, y, x FROM {hit} WHERE hit)"


def _morph(first: str, second: str) -> str:
    return f"WITH {PIXELS}, {_step('m1', 'fg', first)}, {_step('m2', 'm1', second)} SELECT id, count(*) AS n_px, CAST(sum(y * 8 + x) AS BIGINT) AS where_px FROM m2 GROUP BY id"


#: Regions of the tiles whose first two columns are not tissue: threshold, closing, filling, labelling.
IMAGE = f"""WITH RECURSIVE {PIXELS}, f0 AS (SELECT id, y, x FROM px WHERE gray >= 150 AND x >= 2), {_step('f1', 'f0', 'dilate')}, {_step('f2', 'f1', 'erode')}, bg AS (SELECT id, y, x FROM px EXCEPT SELECT id, y, x FROM f2),
outside(id, y, x) AS (SELECT id, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT bg.id, bg.y, bg.x FROM outside o, cross5, bg WHERE bg.id = o.id AND bg.y = o.y + dy AND bg.x = o.x + dx),
solid AS (SELECT id, y, x FROM px EXCEPT SELECT id, y, x FROM outside){FLOOD.replace("fg", "solid")},
m AS (SELECT id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, min(x) = 0 OR min(y) = 0 OR max(x) = 7 OR max(y) = 7 AS rim, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM lab GROUP BY id, label),
g AS (SELECT *, n * 0.25::DOUBLE AS a, (vx + vy) / 2 AS h, sqrt(((vx - vy) / 2) ** 2 + c * c) AS s FROM m)"""


def _flood4(name: str, source: str) -> str:
    """Regions of a set of places by their edges, each named by its least place of 3 rows of 7."""
    return (
        f"{name}_r(id, y, x, o) AS (SELECT id, y, x, y * 7 + x FROM {source} UNION SELECT q.id, q.y, q.x, r.o FROM {name}_r r, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx), {source} q WHERE q.id = r.id AND q.y = r.y + dy AND q.x = r.x + dx), "
        f"{name}_p AS (SELECT id, y, x, min(o) AS o FROM {name}_r GROUP BY id, y, x), {name} AS (SELECT *, count(*) OVER (PARTITION BY id, o) AS area FROM {name}_p)"
    )


VOTES = ", lv AS (SELECT 100 + k * 12 AS level FROM range(9) t(k)), vt AS (SELECT id, y, x, count(*) FILTER (WHERE gray >= level) AS votes FROM px, lv GROUP BY id, y, x)"
ROUND9 = lambda *c: ", ".join(f"round({x}, 9) AS {x}" for x in c)
ROUND6 = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
QUOTA = "CASE WHEN n <= 2 THEN 0 ELSE greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) END"
CAND = ", cand AS (SELECT slide, x, y, round(coalesce(macro_area_um2, 0) / tissue_area_um2 * 100, 6) AS macro_pct FROM tiles LEFT JOIN tally USING (slide, tile))"
MEMBERS = "(200, 20.0, 0.80), (200, 40.0, 0.85), (200, 60.0, 0.75), (210, 20.0, 0.85), (210, 40.0, 0.80), (210, 60.0, 0.80), (220, 20.0, 0.75), (220, 40.0, 0.80), (220, 60.0, 0.85)"
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(slide AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"
METRICS = ("pos_mean", "pos_min", "neg_mean", "neg_max", "margin", "auc")

SQL = {
    "component_verdicts": f"WITH {BASE} SELECT verdict, count(*) AS n, sum(area_um2) AS area_um2, count(*) FILTER (WHERE touches_border) AS n_border FROM judged GROUP BY verdict",
    "tile_tally": f"WITH {BASE} SELECT * FROM tally",
    "tile_tally_dense": f"WITH {BASE} SELECT slide, tile, x, y, tissue_area_um2, {ZERO} FROM tiles LEFT JOIN tally USING (slide, tile)",
    "border_excluded": f"WITH {BASE} SELECT slide, tile, macro_count, macro_area_um2, border_count, rej_border FROM (SELECT slide, tile, {_tally('true')} FROM judged GROUP BY slide, tile)",
    "tile_table": f"""WITH {BASE}, ex AS (SELECT slide, tile, {_tally('true')} FROM judged GROUP BY slide, tile),
        m AS (SELECT slide, tile, {", ".join(f"avg(area_um2) FILTER (WHERE verdict = '{k}' AND NOT touches_border) AS {k}_mean, median(area_um2) FILTER (WHERE verdict = '{k}' AND NOT touches_border) AS {k}_median" for k in ("macro", "micro"))} FROM judged GROUP BY slide, tile),
        t AS (SELECT tiles.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("macro_count", "micro_count", "macro_area_um2", "micro_area_um2", "border_count", "border_area_um2", *(f"rej_{r}" for r in (*REASONS, "border"))))}, {", ".join(f"coalesce({k}_{m}, 0.0) AS {k}_{m}" for k in ("macro", "micro") for m in ("mean", "median"))} FROM tiles LEFT JOIN ex USING (slide, tile) LEFT JOIN m USING (slide, tile))
        SELECT slide, x AS tile_x, y AS tile_y, CAST(512 AS INT) AS tile_size, tissue_area_um2 / 65536 AS tissue_fraction, tissue_area_um2, CAST(210 AS DOUBLE) AS threshold,
          {", ".join(f"{k}_count, {k}_area_um2, round({k}_area_um2 / tissue_area_um2, 9) AS {k}_fat_fraction, round({k}_mean, 6) AS {k}_mean_area_um2, round({k}_median, 6) AS {k}_median_area_um2" for k in ("macro", "micro"))},
          macro_count + micro_count AS total_count, macro_area_um2 + micro_area_um2 AS total_area_um2, round((macro_area_um2 + micro_area_um2) / tissue_area_um2, 9) AS total_fat_fraction, border_count, border_area_um2,
          {", ".join(f"rej_{r}" for r in (*REASONS, "border"))} FROM t""",
    "slide_report": f"""WITH {BASE}, few AS (SELECT * FROM tiles WHERE x < 1536), k AS (SELECT slide, {_tally()} FROM judged SEMI JOIN few USING (slide, tile) GROUP BY slide),
        g AS (SELECT slide, count(*) AS tiles, sum(tissue_area_um2) AS tissue FROM few GROUP BY slide), f AS (SELECT slide, count(*) AS tiles_candidate, sum(tissue_area_um2) / 1e6 AS slide_tissue_area_mm2 FROM tiles GROUP BY slide)
        SELECT slide, g.tiles, tiles_candidate, round(slide_tissue_area_mm2, 9) AS slide_tissue_area_mm2, coalesce(macro_count, 0) AS macro_count, coalesce(micro_count, 0) AS micro_count,
          round(coalesce(macro_area_um2, 0) / tissue, 9) AS macro_fraction, round(coalesce(micro_area_um2, 0) / tissue, 9) AS micro_fraction, round(coalesce(border_area_um2 / nullif(macro_area_um2 + micro_area_um2, 0), 0), 9) AS border_share
        FROM g JOIN f USING (slide) LEFT JOIN k USING (slide)""",
    "class_stats": f"""WITH {BASE}, k AS (SELECT slide, verdict AS klass, area_um2 FROM judged WHERE verdict IN ('macro', 'micro') UNION ALL SELECT slide, 'all', area_um2 FROM judged WHERE verdict IN ('macro', 'micro'))
        SELECT slide, klass, count(*) AS n, sum(area_um2) AS area_um2, round(avg(area_um2), 6) AS mean_area_um2, round(median(area_um2), 6) AS median_area_um2 FROM k GROUP BY slide, klass""",
    "slide_summary": f"WITH {BASE} SELECT * REPLACE ({ROUND9('macro_fraction', 'micro_fraction', 'total_fraction', 'border_share')}) FROM summary",
    "cohort_summary": f"""WITH {BASE}, c AS (
        SELECT coalesce(cohort, 'all') AS cohort, count(*) AS slides, CAST(sum(tiles) AS BIGINT) AS tiles, sum(tissue_area_um2) AS tissue_area_um2, CAST(sum(macro_count) AS BIGINT) AS macro_count, CAST(sum(micro_count) AS BIGINT) AS micro_count,
          sum(macro_area_um2) AS macro_area_um2, sum(micro_area_um2) AS micro_area_um2, avg(macro_fraction) AS macro_mean, min(macro_fraction) AS macro_min, max(macro_fraction) AS macro_max FROM summary JOIN slides USING (slide) GROUP BY ROLLUP (cohort))
        SELECT cohort, slides, tiles, tissue_area_um2, macro_count, micro_count, macro_area_um2, micro_area_um2, {ROUND9('macro_mean', 'macro_min', 'macro_max')}, round(macro_area_um2 / tissue_area_um2, 9) AS macro_weighted, round(micro_area_um2 / tissue_area_um2, 9) AS micro_weighted, round(macro_max - macro_min, 9) AS macro_spread FROM c""",
    "survey_sample": f"WITH {BASE}{SURVEY} SELECT * FROM survey",
    "group_stats": f"WITH {BASE}{SURVEY} SELECT cohort, count(*) AS n, round(sum(ma / tissue * 100), 6) AS sum_pct, round(avg(ma / tissue * 100), 6) AS mean_pct, round(min(ma / tissue * 100), 6) AS min_pct, round(max(ma / tissue * 100), 6) AS max_pct FROM s JOIN slides USING (slide) GROUP BY cohort",
    "param_grid": f"WITH {BASE}{SWEEP} SELECT * FROM grid",
    "sweep_per_slide": f"WITH {BASE}{SWEEP} SELECT * REPLACE ({ROUND9('macro_pct', 'micro_pct')}) FROM sweep",
    "score_sweep": f"""WITH {BASE}{SWEEP}, c AS (SELECT {KEYS}, {SEPARATE}, median(macro_pct) FILTER (WHERE "group" = 'positive') AS pos_median, median(macro_pct) FILTER (WHERE "group" = 'negative') AS neg_median FROM sweep GROUP BY {KEYS})
        SELECT {KEYS}, {ROUND6('pos_mean', 'pos_min', 'pos_median', 'neg_mean', 'neg_max', 'neg_median')}, round(pos_min - neg_max, 6) AS margin, round(pos_mean / nullif(neg_mean, 0), 6) AS ratio, round(pos_min / nullif(neg_max, 0), 6) AS worst_ratio FROM c""",
    "score_cells": f"""WITH {BASE}{SWEEP}, c AS (SELECT {KEYS}, {SEPARATE} FROM sweep GROUP BY {KEYS}), a AS ({_auc("sweep", KEYS)})
        SELECT {KEYS}, {ROUND6('pos_mean', 'pos_min', 'neg_mean', 'neg_max', 'auc')}, round(pos_min - neg_max, 6) AS margin, round(pos_mean / nullif(neg_mean, 0), 6) AS ratio FROM c JOIN a USING ({KEYS})""",
    "auc": f"WITH {BASE}, v AS (SELECT 1 AS one, cohort AS \"group\", macro_area_um2 AS macro_pct FROM summary JOIN slides USING (slide)), a AS ({_auc('v', 'one')}) SELECT round(auc, 9) AS auc FROM a",
    "top_cells": f"WITH {BASE}{SWEEP} SELECT {KEYS}, round(min(macro_pct) FILTER (WHERE \"group\" = 'positive') - max(macro_pct) FILTER (WHERE \"group\" = 'negative'), 6) AS margin FROM sweep GROUP BY {KEYS} ORDER BY margin DESC NULLS LAST, {KEYS} LIMIT 5",
    "holdout": f"WITH {BASE}{SWEEP}{HOLD} SELECT * REPLACE ({ROUND9('tune_metric', 'test_metric', 'test_auc', 'test_pos_mean', 'test_neg_mean')}) FROM hold",
    "stability": f"WITH {BASE}{SWEEP}{HOLD} SELECT {KEYS}, count(*) AS times_selected, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM hold GROUP BY {KEYS}",
    "optimism": f"WITH {BASE}{SWEEP}{HOLD} SELECT round(avg(tune_metric) - avg(test_metric), 8) AS optimism, round(avg(test_metric), 8) AS test_mean, round(quantile_cont(test_metric, 0.025), 8) AS test_lo, round(quantile_cont(test_metric, 0.975), 8) AS test_hi FROM hold",
    "bootstrap_ci": f"""WITH {BASE}{SWEEP}, b AS (SELECT "group", macro_pct, row_number() OVER (PARTITION BY "group" ORDER BY slide) - 1 AS i, count(*) OVER (PARTITION BY "group") AS n FROM sweep WHERE white = 210 AND circularity_min = 0.55 AND min_area_um2 = 40 AND max_eccentricity = 0.8),
        dr AS (SELECT boot, s."group", ('0x' || substr(md5('7|' || boot || '|' || s."group" || '|' || s.i), 1, 12))::BIGINT % s.n AS i FROM b s, unnest(range(2000)) AS r(boot)),
        d AS (SELECT boot, "group", macro_pct FROM dr JOIN b USING ("group", i) UNION ALL SELECT -1, "group", macro_pct FROM b),
        m AS (SELECT boot, {SEPARATE} FROM d GROUP BY boot), a AS ({_auc('d', 'boot')}), f AS (SELECT *, pos_min - neg_max AS margin FROM m JOIN a USING (boot)),
        l AS ({' UNION ALL '.join(f"SELECT boot, '{x}' AS metric, {x} AS v FROM f" for x in METRICS)})
        SELECT metric, round(max(v) FILTER (WHERE boot = -1), 8) AS observed, round(avg(v) FILTER (WHERE boot >= 0), 8) AS boot_mean, round(quantile_cont(v, 0.025) FILTER (WHERE boot >= 0), 8) AS ci_lo, round(quantile_cont(v, 0.975) FILTER (WHERE boot >= 0), 8) AS ci_hi FROM l GROUP BY metric""",
    "split_plan": f"""WITH {BASE}, n AS (SELECT cohort, count(*) AS n FROM slides GROUP BY cohort), q AS (SELECT cohort, n, {QUOTA} AS t FROM n),
        k AS (SELECT cohort, 'train' AS split, n - 2 * t AS quota FROM q UNION ALL SELECT cohort, 'val', t FROM q UNION ALL SELECT cohort, 'test', t FROM q),
        p AS (SELECT cohort, split, row_number() OVER (PARTITION BY cohort ORDER BY (quota - j) / quota::DOUBLE DESC, quota DESC, split DESC) AS place FROM k, unnest(range(quota)) AS r(j) WHERE quota > 0),
        o AS (SELECT cohort, slide, row_number() OVER (PARTITION BY cohort ORDER BY macro_fraction, slide) AS place FROM slides JOIN summary USING (slide))
        SELECT cohort, slide, split FROM o JOIN p USING (cohort, place)""",
    "split_random": f"""WITH {BASE}, o AS (SELECT cohort, slide, count(*) OVER (PARTITION BY cohort) AS n, row_number() OVER (PARTITION BY cohort ORDER BY md5('7|' || slide), slide) AS place FROM slides)
        SELECT cohort, slide, CASE WHEN place <= {QUOTA} THEN 'test' WHEN place <= 2 * {QUOTA} THEN 'val' ELSE 'train' END AS split FROM o""",
    "split_lookup": f"""WITH {BASE}, o AS (SELECT cohort, slide, count(*) OVER (PARTITION BY cohort) AS n, row_number() OVER (PARTITION BY cohort ORDER BY md5('7|' || slide), slide) AS place FROM slides)
        SELECT CASE WHEN cohort <> 'positive' OR place <= {QUOTA} THEN 'test' WHEN place <= 2 * {QUOTA} THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM o GROUP BY 1""",
    "stratified_pick": f"""WITH {BASE}{CAND},
        edges AS (SELECT quantile_cont(macro_pct, [1 / 6.0, 2 / 6.0, 3 / 6.0, 4 / 6.0, 5 / 6.0]) AS e FROM cand),
        st AS (SELECT cand.*, CAST(len(list_filter(e, lambda v: macro_pct >= v)) AS INT) AS stratum, md5('7|' || slide || '|' || x || '|' || y) AS k FROM cand, edges),
        rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, slide, x, y) > 6 AS topped_up FROM st)
        SELECT slide, x, y, macro_pct, stratum, topped_up FROM rk ORDER BY topped_up, CASE WHEN NOT topped_up THEN stratum END, k, slide, x, y LIMIT 40""",
    "size_histogram": f"""WITH {BASE}, r AS (SELECT min(area_um2) AS lo, CASE WHEN max(area_um2) <= min(area_um2) THEN min(area_um2) + 1 ELSE max(area_um2) END AS hi FROM components),
        b AS (SELECT CAST(least(11, floor((area_um2 - lo) * 12 / (hi - lo))) AS INT) AS bin, count(*) AS n FROM components, r GROUP BY 1),
        h AS (SELECT CAST(i AS INT) AS bin, lo + i * ((hi - lo) / 12) AS l, lo + (i + 1) * ((hi - lo) / 12) AS h, coalesce(n, 0) AS n FROM r CROSS JOIN unnest(range(12)) AS t(i) LEFT JOIN b ON b.bin = i)
        SELECT bin, round(l, 6) AS lo, round(h, 6) AS hi, n, CAST(round_even(40.0 * n / max(n) OVER (), 0) AS INT) AS bar FROM h""",
    "ensemble_member_pct": f"""WITH {BASE}, m AS (SELECT 'w' || w || '_a' || CAST(a AS INT) || '_e' || printf('%.2f', e) AS name, w AS white, CAST(a AS DOUBLE) AS min_area_um2, CAST(e AS DOUBLE) AS max_eccentricity FROM (VALUES {MEMBERS}) v(w, a, e)),
        v AS (SELECT slide, name, area_um2, {VERDICT} AS verdict FROM components JOIN m USING (white), (SELECT max_area_um2, circularity_min, solidity_min, micro_min_area_um2, micro_circularity_min, micro_solidity_min FROM params)),
        a AS (SELECT slide, name, sum(area_um2) AS area FROM v WHERE verdict = 'macro' GROUP BY slide, name)
        SELECT slide, name, round(coalesce(area, 0) / tissue_area_um2 * 100, 9) AS pct FROM ground CROSS JOIN m LEFT JOIN a USING (slide, name)""",
    "pixel_votes": f"WITH {PIXELS}{VOTES} SELECT votes, CAST(floor(votes * 255 / 9.0) AS INT) AS confidence, count(*) AS n_px FROM vt GROUP BY ALL",
    "agreement": f"""WITH {PIXELS}{VOTES}, a AS (SELECT id, count(*) FILTER (WHERE votes > 0) AS any_px, count(*) FILTER (WHERE votes >= 5) AS consensus_px, count(*) FILTER (WHERE votes = 9) AS unanimous_px FROM vt GROUP BY id)
        SELECT *, round(coalesce(unanimous_px / nullif(any_px, 0)::DOUBLE, 0), 9) AS unanimous_of_any, round(coalesce(unanimous_px / nullif(consensus_px, 0)::DOUBLE, 0), 9) AS unanimous_of_consensus, round(CASE WHEN consensus_px > 0 THEN 1 - unanimous_px / consensus_px::DOUBLE ELSE 0 END, 9) AS contested_of_consensus FROM a""",
    "tile_grid": "SELECT p_partkey AS slide, count(*) AS tiles, CAST(max(x) AS INT) AS max_x, CAST(max(y) AS INT) AS max_y FROM part, unnest(range(0, p_size * 64 - 511, 384)) AS a(x), unnest(range(0, p_size * 40 + 100 - 511, 384)) AS b(y) GROUP BY p_partkey",
    "natural_sort": "SELECT 'Slide ' || s_suppkey || '-b' || s_suppkey % 7 AS stem, 'slide ' || lpad(CAST(length(CAST(s_suppkey AS VARCHAR)) AS VARCHAR), 10, '0') || s_suppkey || '-b' || '0000000001' || s_suppkey % 7 AS sort_key FROM supplier",
    "tile_names": f"WITH {BASE} SELECT slide, tile, printf('tile_x%06d_y%06d', x, y) AS tile_name FROM tiles",
    "slide_seed": f"WITH {BASE} SELECT slide, CAST(xor({CRC32}, 7) AS BIGINT) AS seed FROM slides",
    "white_mask": f"WITH {PIXELS} SELECT id, count(*) FILTER (WHERE gray >= 140) AS n_white FROM px GROUP BY id",
    # variances as whole quotients and three more digits to the base 10^12: exact up to rasters of 10^8 pixels
    "otsu": f"""WITH {PIXELS}, h AS (SELECT id, gray AS v, count(*) AS c FROM px WHERE gray IS NOT NULL AND id IS NOT NULL GROUP BY id, gray),
        s AS (SELECT id, v, CAST(sum(c) OVER run AS HUGEINT) AS n, CAST(sum(c * v) OVER run AS HUGEINT) AS m, CAST(sum(c) OVER (PARTITION BY id) AS HUGEINT) AS tn, CAST(sum(c * v) OVER (PARTITION BY id) AS HUGEINT) AS tm FROM h WINDOW run AS (PARTITION BY id ORDER BY v ROWS UNBOUNDED PRECEDING)),
        q AS (SELECT id, v, (m * tn - tm * n) * (m * tn - tm * n) AS a, nullif(n * (tn - n), 0) AS b FROM s),
        q1 AS (SELECT id, v, b, a // b AS d0, a % b * 1000000000000 AS r FROM q), q2 AS (SELECT id, v, b, d0, r // b AS d1, r % b * 1000000000000 AS r FROM q1), q3 AS (SELECT id, v, b, d0, d1, r // b AS d2, r % b * 1000000000000 AS r FROM q2)
        SELECT id, CAST(v AS INT) AS threshold FROM q3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d0 DESC NULLS LAST, d1 DESC NULLS LAST, d2 DESC NULLS LAST, r // b DESC NULLS LAST, v) = 1""",
    "morph_open": _morph("erode", "dilate"),
    "morph_close": _morph("dilate", "erode"),
    "fill_holes": f"""WITH RECURSIVE {PIXELS}, bg AS (SELECT id, y, x FROM px WHERE gray < 140),
        outside(id, y, x) AS (SELECT id, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT bg.id, bg.y, bg.x FROM outside o, cross5, bg WHERE bg.id = o.id AND bg.y = o.y + dy AND bg.x = o.x + dx)
        SELECT id, count(*) AS n_px, CAST(sum(y * 8 + x) AS BIGINT) AS where_px FROM (SELECT id, y, x FROM px EXCEPT SELECT id, y, x FROM outside) GROUP BY id""",
    "label_components": f"WITH RECURSIVE {PIXELS}{FLOOD} SELECT id, count(*) AS n, max(area_px) AS largest, CAST(sum(area_px) AS BIGINT) AS n_px FROM reg GROUP BY id",
    "region_moments": f"""WITH RECURSIVE {PIXELS}{FLOOD}, m AS (SELECT id, label, count(*) AS area_px, avg(x) AS centroid_x, avg(y) AS centroid_y, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM lab GROUP BY id, label),
        g AS (SELECT *, (vx + vy) / 2 AS h, sqrt(((vx - vy) / 2) ** 2 + c * c) AS s FROM m)
        SELECT id, label, area_px, {ROUND6('centroid_x', 'centroid_y')}, min_x, min_y, max_x, max_y, round(CASE WHEN h + s <= 0 THEN 0 ELSE sqrt(greatest(0, 1 - (h - s) / (h + s))) END, 6) AS eccentricity, round(sqrt(4.0 * area_px / pi()) * 0.5, 6) AS diameter_um FROM g""",
    "keep_largest": f"WITH RECURSIVE {PIXELS}{FLOOD} SELECT id, label, area_px FROM reg QUALIFY row_number() OVER (PARTITION BY id ORDER BY area_px DESC, label) <= 2",
    "small_objects": f"WITH RECURSIVE {PIXELS}{FLOOD} SELECT id, count(*) AS n_px, CAST(sum(y * 8 + x) AS BIGINT) AS where_px FROM lab JOIN reg USING (id, label) WHERE area_px > 3 GROUP BY id",
    "tissue_fraction": f"""WITH {PIXELS}, b AS (SELECT id, bx.x, bq.y, bx.x // 4 AS x0, bq.y // 4 AS y0, least(8, CAST(ceil((bx.x + 10) / 4.0) AS INT)) AS x1, least(8, CAST(ceil((bq.y + 10) / 4.0) AS INT)) AS y1 FROM (SELECT DISTINCT id FROM px) i, (VALUES (0), (7), (25)) bx(x), (VALUES (3), (20)) bq(y))
        SELECT b.id, CAST(b.x AS INT) AS x, CAST(b.y AS INT) AS y, CAST(10 AS INT) AS size, round(coalesce(avg(CASE WHEN gray >= 140 THEN 1.0 ELSE 0.0 END), 0), 9) AS tissue_fraction FROM b LEFT JOIN px ON px.id = b.id AND px.x >= x0 AND px.x < x1 AND px.y >= y0 AND px.y < y1 GROUP BY b.id, b.x, b.y""",
    "mask_stats": f"WITH RECURSIVE {PIXELS}{FLOOD}, c AS (SELECT id, CAST(sum(area_px) AS BIGINT) AS n, count(*) AS k FROM reg GROUP BY id) SELECT id, coalesce(n, 0) AS n_px, CAST(coalesce(n, 0) * 0.25 AS DOUBLE) AS area_um2, coalesce(n, 0) / 64.0::DOUBLE AS coverage, coalesce(k, 0) AS n_components FROM (SELECT DISTINCT id FROM px) LEFT JOIN c USING (id)",
    "image_regions": f"""{IMAGE} SELECT CAST(id AS VARCHAR) AS slide, CAST(150 AS INT) AS white, label, a AS area_um2, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y,
        round(CASE WHEN h + s <= 0 THEN 0 ELSE sqrt(greatest(0, 1 - (h - s) / (h + s))) END, 6) AS eccentricity, round(sqrt(4.0 * n / pi()) * 0.5, 6) AS equivalent_diameter_um, rim AS touches_border FROM g""",
    "image_tally": f"""{IMAGE}, v AS (SELECT id, a, rim, CASE WHEN a BETWEEN 1 AND 6 THEN 'macro' WHEN a >= 0.5 AND a < 1 THEN 'micro' WHEN a > 6 THEN 'large' ELSE 'small' END AS k FROM g)
        SELECT CAST(i.id AS VARCHAR) AS slide, 12.0::DOUBLE AS tissue_area_um2, count(*) FILTER (WHERE k = 'macro') AS macro_count, coalesce(sum(a) FILTER (WHERE k = 'macro'), 0.0) AS macro_area_um2, count(*) FILTER (WHERE k = 'micro') AS micro_count,
          count(*) FILTER (WHERE k = 'small') AS rej_too_small, count(*) FILTER (WHERE k = 'large') AS rej_too_large, count(*) FILTER (WHERE k IN ('macro', 'micro') AND rim) AS border_count, round(coalesce(sum(a) FILTER (WHERE k = 'macro'), 0.0) / 12, 6) AS macro_fraction
        FROM (SELECT DISTINCT id FROM px) i LEFT JOIN v ON v.id = i.id GROUP BY i.id""",
    "image_tissue": f"""WITH RECURSIVE {PIXELS}, ch AS (SELECT id, (y * 8 + x) // 3 AS k, gray FROM px WHERE y * 8 + x < 63),
        rgb AS (SELECT id, CAST(k // 7 AS INT) AS y, CAST(k % 7 AS INT) AS x, max(gray) AS hi, min(gray) AS lo FROM ch GROUP BY id, k),
        on0 AS (SELECT id, y, x FROM rgb WHERE hi <= 200 AND hi > 0 AND floor(255.0::DOUBLE * (hi - lo) / hi + 0.5) > 60), off0 AS (SELECT id, y, x FROM rgb EXCEPT SELECT id, y, x FROM on0),
        {_flood4('hole', 'off0')}, on1 AS (SELECT id, y, x FROM on0 UNION ALL SELECT id, y, x FROM hole WHERE area <= 1), {_flood4('part', 'on1')}
        SELECT id, count(*) AS n_px, CAST(sum(y * 7 + x) AS BIGINT) AS where_px FROM part WHERE area > 2 GROUP BY id""",
    "panel_candidates": f"WITH {BASE}, f AS (SELECT slide, tile, round(coalesce(macro_area_um2, 0) / tissue_area_um2 * 100, 6) AS pct, tissue_area_um2 FROM tiles LEFT JOIN tally USING (slide, tile)) SELECT slide, tile, pct FROM f JOIN slides USING (slide) WHERE cohort <> 'negative' AND tissue_area_um2 > 55000 AND pct BETWEEN 3 AND 10",
    "reason_attribution": f"""WITH RECURSIVE {PIXELS}{FLOOD}, s AS (SELECT id, label, count(*) AS area_px, avg(CASE WHEN gray >= 160 THEN 1.0 ELSE 0.0 END) AS share FROM lab JOIN px USING (id, y, x) GROUP BY id, label)
        SELECT CASE WHEN share > 0.5 THEN 'in label' WHEN area_px < 3 THEN 'too_small' ELSE 'too_faint' END AS reason, count(*) AS n, CAST(sum(area_px) AS BIGINT) AS n_px FROM s GROUP BY 1""",
    "slide_levels": """WITH p AS (SELECT p_partkey AS slide, least(p_size, 2) AS level, 0.25::DOUBLE + p_size / 128::DOUBLE AS mpp FROM part)
        SELECT slide, CAST(level AS INT) AS level, round(mpp * pow(4.0, level) * mpp * pow(4.0, level), 6) AS um2_per_px, CAST(greatest(1, round_even(20.0::DOUBLE / (mpp * pow(4.0, level)), 0)) AS INT) AS radius_px FROM p""",
    "shape_measures": "WITH g AS (SELECT CASE WHEN l_discount * 100 <= 0 THEN 0.0 ELSE 4.0 * pi() * (l_quantity / ((l_discount * 100) * (l_discount * 100))) END AS c, sqrt(4.0 * l_quantity / pi()) * sqrt(0.25) AS e FROM lineitem) SELECT round(sum(c), 3) AS sum_circularity, round(sum(e), 3) AS sum_diameter, count(*) FILTER (WHERE c = 0) AS n_zero FROM g",
    "tally_merge": f"WITH {BASE} SELECT * FROM found",
    "rejected_map": f"WITH {BASE} SELECT verdict AS reason, count(*) AS n FROM judged WHERE verdict NOT IN ('macro', 'micro') GROUP BY verdict",
}
