"""Console reports: one line for each slide and cohort. The rows of a report come to the driver, as many as there are slides."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Fat
from tessera.functions.scalar import natural_key

COLUMNS = {"tiles": 7, "tissue mm2": 12, "macro n": 9, "macro %": 9, "micro n": 9, "micro %": 9, "border %": 10}


def _line(name: str, *cells: str) -> str:
    return f"{name:<28}" + "".join(c.rjust(w) for c, w in zip(cells, COLUMNS.values(), strict=True))


def _cells(r, macro: str, micro: str, border: float | None) -> list[str]:
    pct = lambda v: "-" if v is None else f"{100 * v:.2f}"
    return [str(r["tiles"]), f"{r['tissue_area_um2'] / 1e6:.2f}", str(r["macro_count"]), pct(r[macro]), str(r["micro_count"]), pct(r[micro]), pct(border)]


def run_report(summary: DataFrame, cohorts: DataFrame, cfg: Fat) -> str:
    """Slides in the order of their folder, then the cohorts, whose shares weigh slides by tissue area."""
    lines = [_line("slide", *COLUMNS)]
    for r in summary.orderBy("group", natural_key(F.col("slide").cast("string"))).collect():
        lines.append(_line(f"{r['group']}/{r['slide']}", *_cells(r, "macro_fraction", "micro_fraction", r["border_share"])))
    lines.append("")
    for r in cohorts.orderBy(F.asc_nulls_last("group")).collect():
        spread = "" if r["macro_min"] is None else f"   slides: {100 * r['macro_min']:.2f} to {100 * r['macro_max']:.2f} %"
        lines.append(_line("all" if r["group"] is None else r["group"], *_cells(r, "macro_weighted", "micro_weighted", None)) + spread)
    lines.append(f"the small class is {'part of' if cfg.include_microvesicular else 'measured but not in'} the labels; regions at a tile's border are {'left out' if cfg.exclude_border else 'kept'}")
    return "\n".join(lines)


def say_failures(failed: list[dict]) -> None:
    for f in failed:
        print(f"{f['cohort']}/{f['slide']}: {f['stage']}: {f['error']}", file=sys.stderr)
