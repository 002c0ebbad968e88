"""Command line: ``python -m tessera.cli info|tissue|run|batch|survey|sweep|dataset|annotate``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields, is_dataclass

from pyspark.sql import functions as F

from tessera.config import Config
from tessera.export import files, pictures, reports
from tessera.functions.scalar import natural_key
from tessera.operators import ensemble, sampling, sweep, tally
from tessera.plans import imaging, panels
from tessera.session import build_session
from tessera.sources import slides as src


def groups(items: list[str]) -> dict[str, str]:
    """NAME=FOLDER arguments."""
    out = {}
    for item in items:
        name, sep, folder = item.partition("=")
        if not sep or not name or not folder:
            raise SystemExit(f"not NAME=FOLDER: {item!r}")
        out[name] = folder
    return out


def numbers(text: str | None, default: float) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()] if text else [default]


AXES = ("white-threshold", "circularity-min", "solidity-min", "min-area-um2", "max-eccentricity")


def flags() -> dict[str, tuple[str, object]]:
    """A flag for each single-valued parameter: its dotted name and its default. Names that two sections share carry the section's."""
    out = {"limit": ("limit", 0)}
    for section in fields(Config):
        record = getattr(Config(), section.name)
        if is_dataclass(record):
            for f in fields(record):
                value = getattr(record, f.name)
                if not isinstance(value, tuple) and (section.name, f.name) not in (("fat", "micro_max_area_um2"), ("tiling", "level")):
                    name = f"{section.name}_{f.name}" if f.name in ("level", "method") else f.name
                    out[name.replace("_", "-")] = (f"{section.name}.{f.name}", value)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "tissue", "run", "batch", "survey", "sweep", "dataset", "annotate"):
        s = sub.add_parser(name)
        s.add_argument("--group", action="append", required=True, metavar="NAME=FOLDER")
        s.add_argument("--config")
        s.add_argument("--set", action="append", default=[], metavar="PARAMETER=VALUE")
        s.add_argument("--out", default="outputs")
        s.add_argument("--tiles", type=int, default=60)
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--strata", type=int, default=6)
        for flag, (dotted, default) in flags().items():
            if name == "sweep" and flag in AXES:
                s.add_argument(f"--{flag}")
            elif isinstance(default, bool):
                s.add_argument(f"--{'no-' * default}{flag}", dest=dotted, action="store_const", const=not default)
            else:
                s.add_argument(f"--{flag}", dest=dotted, type=type(default))
    return p


def config_of(args: argparse.Namespace) -> Config:
    """Flags over ``--set`` over file over defaults."""
    from tessera.config import _scalar

    base = Config.load(args.config) if args.config else Config()
    return base.with_values({k: _scalar(v) for k, _, v in (x.partition("=") for x in args.set)}).with_values({dotted: getattr(args, dotted, None) for dotted, _ in flags().values()})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    cfg, spark = config_of(args), build_session()
    if args.command == "batch":
        args.command = "run"
    named = groups(args.group)
    tables, failed = [], []
    for group, folder in named.items():
        meta = src.slides(spark, folder)
        if args.command == "info":
            meta.show(truncate=False)
            continue
        files.write_parquet(imaging.tissue(spark, folder, cfg), f"{args.out}/tissue/{group}", None)
        masks = spark.read.parquet(f"{args.out}/tissue/{group}")
        if args.command == "tissue":
            masks.drop("mask").orderBy(natural_key(F.col("slide"))).show(truncate=False)
            reports.say_failures(files.failures({"tissue": masks, "figure": pictures.tissue_figures(spark, masks, folder, cfg, f"{args.out}/qc/{group}")}, group))
            continue
        grid = imaging.tiles(masks, meta, cfg)
        files.write_parquet(imaging.slide_facts(masks, grid), f"{args.out}/slides/{group}", None)
        failed += files.failures({"open": meta, "tissue": masks}, group)
        if args.command in ("survey", "sweep"):
            grid = sampling.sample_tiles(grid, args.tiles, args.seed)
        elif args.command == "run":
            grid = pictures.flagged(sampling.limit_tiles(grid, spark, cfg.limit), cfg)
        files.write_parquet(grid, f"{args.out}/tiles/{group}", None)
        grid = spark.read.parquet(f"{args.out}/tiles/{group}")
        if args.command in ("run", "annotate"):  # several steps look at the same pixels
            imaging.write_store(imaging.pack_tiles(spark, grid, folder), f"{args.out}/pixels/{group}")
            grid = imaging.read_store(spark, f"{args.out}/pixels/{group}")
            failed += files.failures({"pixels": grid}, group)
        tables.append((group, folder, grid))
    if not tables:
        return 0
    files.write_json(files.provenance(cfg, sys.argv if argv is None else argv), f"{args.out}/provenance.json")
    cfg.save(f"{args.out}/config_used.yaml")
    tile = F.struct("x", "y")
    if args.command in ("dataset", "annotate"):
        members, splits = ensemble.default_members(cfg.fat), {}
        for group, folder, grid in tables:
            if args.command == "annotate":
                found = imaging.regions(spark, grid, folder, cfg)
                files.write_parquet(found, f"{args.out}/regions/{group}", None)
                found = spark.read.parquet(f"{args.out}/regions/{group}")
                failed += files.failures({"regions": found}, group)
                some = sampling.stratified_pick(tally.candidates(found.where("error IS NULL").withColumn("tile", tile), imaging.tile_ground(grid), cfg.fat), args.tiles, args.strata, args.seed)
                # as many tiles as were asked for
                few = grid.join(F.broadcast(some.select("slide", "x", "y")), ["slide", "x", "y"], "left_semi")
                files.export_annotations(spark, few, folder, f"{args.out}/annotate", cfg.fat, manifest=f"manifest/{group}")
            else:
                # every tile is voted on once: its slide's severity and its files come from the same table
                few = sampling.sample_tiles(grid, args.tiles, args.seed)
                files.write_parquet(imaging.votes(spark, few, folder, members).withColumn("cohort", F.lit(group)), f"{args.out}/votes/{group}", None)
                v = spark.read.parquet(f"{args.out}/votes/{group}")
                failed += files.failures({"votes": v}, group)
                plan = sampling.plan_splits(panels.severity(panels.tile_counts(v)).withColumn("cohort", F.lit(group)))
                splits[group] = {k: [] for k in ("train", "val", "test")}
                for r in plan.orderBy("slide").collect():
                    splits[group][r["split"]].append(r["slide"])
                files.export_dataset(v.join(plan.select("slide", "split"), "slide"), args.out, manifest=f"manifest/{group}")
        files.write_json(failed, f"{args.out}/failures.json")
        if args.command == "dataset":
            files.write_json(splits, f"{args.out}/splits.json")
            keep = ("white_threshold", "min_area_um2", "max_eccentricity", "circularity_min", "solidity_min")
            files.write_json([{"name": n, **{k: getattr(m, k) for k in keep}} for n, m in members], f"{args.out}/ensemble.json")
        return 0
    whites = tuple(int(w) for w in numbers(getattr(args, "white_threshold", None), cfg.fat.white_threshold))
    parts = []
    for group, folder, grid in tables:
        files.write_parquet(imaging.regions(spark, grid, folder, cfg, whites), f"{args.out}/regions/{group}", None)
        found, ground = spark.read.parquet(f"{args.out}/regions/{group}"), imaging.tile_ground(grid)
        failed += files.failures({"regions": found}, group)
        found = found.where("error IS NULL").withColumn("tile", tile)
        if args.command == "sweep":
            axes = {n: numbers(getattr(args, n), getattr(cfg.fat, n)) for n in ("circularity_min", "solidity_min", "min_area_um2", "max_eccentricity")}
            cells = len(whites)
            for v in axes.values():
                cells *= len(v)
            out = sweep.sweep(found, ground, sweep.parameter_grid(spark, whites, axes), cfg.fat, cells)
        elif args.command == "survey":
            sizes = grid.select("slide", "x", "y", "population")
            out = sampling.survey_rows(tally.tile_tally(found, cfg.fat), ground.join(sizes, ["slide", "x", "y"]))
            out = tally.with_facts(out, spark.read.parquet(f"{args.out}/slides/{group}").select("slide", F.col("slide_tissue_mm2").alias("tissue_mm2"), "components", "otsu"))
        else:
            whole = ground.join(grid.select("slide", "x", "y", "size", "tissue_fraction"), ["slide", "x", "y"])
            files.write_csv(files.tile_table(tally.tile_rows(found, whole, cfg.fat)), f"{args.out}/tiles_csv/{group}")
            out = tally.with_facts(tally.slide_summary(found, ground, cfg.fat), spark.read.parquet(f"{args.out}/slides/{group}").select("slide", "tiles_candidate", F.col("slide_tissue_mm2").alias("slide_tissue_area_mm2")))
            drawn = pictures.save_tiles(spark, pictures.chosen(grid, cfg), folder, cfg, f"{args.out}/pictures/{group}")
            failed += files.failures({"pictures": drawn}, group)
        parts.append(out.withColumn("group", F.lit(group)))
    files.write_json(failed, f"{args.out}/failures.json")
    reports.say_failures(failed)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    files.write_csv(every, f"{args.out}/{args.command}")
    every = spark.read.option("header", True).schema(every.schema).csv(f"{args.out}/{args.command}")
    if args.command == "sweep" and len(named) > 1:
        first, second = list(named)[:2]
        scored = sweep.score_sweep(every, first, second)
        files.write_csv(scored, f"{args.out}/sweep_scored")
        scored.show(10)
    elif args.command == "run":
        print(reports.run_report(every, tally.cohort_summary(every, "group"), cfg.fat))
    else:
        every.orderBy("group", natural_key(F.col("slide").cast("string"))).show(20)
    return 0


if __name__ == "__main__":
    sys.exit(main())
