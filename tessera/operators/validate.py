"""Repeated hold-out selection and bootstrap intervals, each as one distributed job over all repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import sample_key
from tessera.operators.sweep import parameter_keys

LOW, HIGH = 0.025, 0.975


def test_size(n: Column, fraction: float) -> Column:
    """At least two; halves round to even."""
    return F.greatest(F.lit(2), F.bround(n * fraction).cast("int"))


def holdout_splits(spark: SparkSession, df: DataFrame, repeats: int, fraction: float, seed: int) -> DataFrame:
    """(rep, slide, group, is_test): each repeat draws test slides within each group, by the order of a hash."""
    slides = df.select("slide", "group").distinct()
    n = F.count("*").over(Window.partitionBy("group"))
    slides = slides.withColumn("take", test_size(n, fraction))
    drawn = slides.crossJoin(spark.range(repeats).select(F.col("id").cast("int").alias("rep")))
    order = Window.partitionBy("rep", "group").orderBy(sample_key(seed, F.col("rep"), F.col("slide")), "slide")
    return drawn.select("rep", "slide", "group", (F.row_number().over(order) <= F.col("take")).alias("is_test"))


def _sides(values: np.ndarray, member: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, least and greatest of the values under each column of a 0/1 matrix; NaN where a column has none. Values that are NaN count for nothing."""
    known = ~np.isnan(values)
    values, member = values[known], member[known]
    n = member.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = {"mean": (values @ member) / n}
    for name, far, of in (("min", np.inf, np.min), ("max", -np.inf, np.max)):
        v = of(np.where(member > 0, values[:, None], far), axis=0, initial=far)
        out[name] = np.where(n > 0, v, np.nan)
    return out


def _auc(p: np.ndarray, q: np.ndarray) -> float:
    """The chance that a value of p exceeds one of q, ties counting half; NaN without one. A NaN lies below all values."""
    if not len(p) or not len(q):
        return float("nan")
    p, q = (np.nan_to_num(x, nan=-np.inf) for x in (p, q))
    q = np.sort(q)
    return float((np.searchsorted(q, p, "left") + np.searchsorted(q, p, "right")).sum() / (2 * len(p) * len(q)))


def _scores(pos: dict[str, np.ndarray], neg: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The separation of two sides by repeat, as ``sweep`` derives it."""
    over = lambda a, b: np.divide(a, b, out=np.full_like(a, np.nan), where=b != 0)
    return {
        "pos_mean": pos["mean"], "pos_min": pos["min"], "neg_mean": neg["mean"], "neg_max": neg["max"], "margin": pos["min"] - neg["max"],
        "ratio": over(pos["mean"], neg["mean"]), "worst_ratio": over(pos["min"], neg["max"]),
    }


def _null(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def holdout(spark: SparkSession, df: DataFrame, repeats: int = 300, fraction: float = 0.3, seed: int = 0, metric: str = "margin", positive: str = "positive", negative: str = "negative") -> DataFrame:
    """One row for each repeat: the cell chosen on the tuning slides, its metric there, and its scores on the test slides.

    A slide carries its side in every repeat as one array, so a sweep row stays one row: each cell is scored in all repeats at once, from
    its slides' values and sides. A cell's task holds one value and ``repeats`` sides for each slide.
    """
    keys = parameter_keys(df)
    drawn = holdout_splits(spark, df, repeats, fraction, seed).groupBy("slide").agg(F.transform(F.sort_array(F.collect_list(F.struct("rep", "is_test"))), lambda x: x.is_test).alias("sides"))
    rows = df.where(F.col("group").isin(positive, negative)).select("slide", *keys, (F.col("group") == positive).alias("pos"), F.col("macro_pct").cast("double").alias("v")).join(drawn, "slide").drop("slide")
    named = [f"{side}_{m}" for side, ms in (("tune", (metric,)), ("test", (metric, "auc", "pos_mean", "neg_mean"))) for m in ms]
    names = ["rep", *keys, "tune_metric", "test_metric", "test_auc", "test_pos_mean", "test_neg_mean"]
    schema = T.StructType([T.StructField("rep", T.IntegerType()), *[df.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names[-5:]]])

    def one(key: tuple, t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
        pos = t["pos"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        test = t["sides"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int8).reshape(len(v), repeats)
        got = {}
        for name, member in (("tune", 1 - test), ("test", test)):
            got |= {f"{name}_{m}": x for m, x in _scores(_sides(v[pos], member[pos]), _sides(v[~pos], member[~pos])).items()}
        got["test_auc"] = np.array([_auc(v[pos & (side > 0)], v[~pos & (side > 0)]) for side in test.T])
        return pa.table([pa.array(np.arange(repeats, dtype=np.int32)), *[pa.repeat(k, repeats) for k in key], *[_null(got[n]) for n in named]], names=names)

    # rows are few and the work on each cell is not: a number keeps the planner from merging tasks by their bytes
    every = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys).applyInArrow(one, schema)
    best = Window.partitionBy("rep").orderBy(F.desc("tune_metric"), *keys)
    return every.where(F.col("tune_metric").isNotNull()).withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")


def optimism(repeats: DataFrame) -> DataFrame:
    """Mean tuning metric less mean test metric, with the test metric's mean and interval."""
    known = F.when(~F.isnan("test_metric"), F.col("test_metric"))
    p = F.percentile(known, F.array(F.lit(LOW), F.lit(HIGH)))
    return repeats.agg((F.avg("tune_metric") - F.avg("test_metric")).alias("optimism"), F.avg(known).alias("test_mean"), p.alias("p")).select("optimism", "test_mean", F.col("p")[0].alias("test_lo"), F.col("p")[1].alias("test_hi"))


def stability(repeats: DataFrame, keys: list[str]) -> DataFrame:
    """How often each cell was chosen, and its share of all choices."""
    g = repeats.groupBy(*keys).agg(F.count("*").alias("times_selected"))
    return g.withColumn("pct", F.col("times_selected") * 100.0 / F.sum("times_selected").over(Window.partitionBy()))


METRICS = ("pos_mean", "pos_min", "neg_mean", "neg_max", "margin", "auc")


def cell_rows(df: DataFrame, cell: dict) -> DataFrame:
    """The rows of one parameter cell; running it fails if there are none."""
    for k, v in cell.items():
        df = df.where(F.col(k) == v)
    n = df.agg(F.assert_true(F.count("*") > 0, F.lit(f"no sweep rows match {cell}")).alias("ok"))
    return df.crossJoin(F.broadcast(n)).where("ok IS NULL").drop("ok")


#: Draws that one row of the bootstrap makes.
DRAWS = 50


def bootstrap(spark: SparkSession, rows: DataFrame, boots: int = 2000, seed: int = 0, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """(metric, observed, boot_mean, ci_lo, ci_hi) of one cell's rows (slide, group, macro_pct), slides resampled with replacement.

    Slide i of a group of n is drawn by md5(seed | boot | group | slot) modulo n. A draw gives each slide a weight, how often it was
    drawn; means, extremes and rank sums follow from values and weights, so no row is made for a drawn slide. Every task holds one
    value for each slide and makes DRAWS draws a row; draws are dealt over tasks.
    """
    value = F.struct("slide", F.coalesce(F.col("macro_pct").cast("double"), F.lit(float("nan"))).alias("v"))
    sides = rows.agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("group") == g, value))), lambda x: x.v).alias(n) for n, g in (("p", positive), ("q", negative))])
    blocks = spark.range(0, -(-boots // DRAWS) + 1).select((F.col("id").cast("int") - 1).alias("block"))  # block -1: the rows as they are
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    schema = "boot int, " + ", ".join(f"{m} double" for m in METRICS)

    def draws(boot: int, group: str, n: int) -> np.ndarray:
        head = f"{seed}|{boot}|{group}|"
        at = np.array([int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:12], 16) for i in range(n)], np.int64)
        return np.bincount(at % max(n, 1), minlength=n)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                p, q = (np.array(r[k] or [], float) for k in ("p", "q"))
                whose = [-1] if r["block"] < 0 else list(range(r["block"] * DRAWS, min(boots, (r["block"] + 1) * DRAWS)))
                weigh = lambda boot, group, v: np.ones(len(v), np.int64) if boot < 0 else draws(boot, group, len(v))
                wp, wq = (np.stack([weigh(boot, g, v) for boot in whose], axis=1) for g, v in ((positive, p), (negative, q)))
                got = _scores(_sides(p, wp), _sides(q, wq))
                got["auc"] = np.array([_auc(np.repeat(p, wp[:, k]), np.repeat(q, wq[:, k])) for k in range(len(whose))])
                yield pa.RecordBatch.from_arrays([pa.array(whose, pa.int32()), *[_null(got[m]) for m in METRICS]], names=["boot", *METRICS])

    every = blocks.join(F.broadcast(sides)).mapInArrow(run, schema)
    long = every.select("boot", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "v"))
    drawn = F.when(F.col("boot") >= 0, F.col("v"))
    g = long.groupBy("metric").agg(F.max(F.when(F.col("boot") < 0, F.col("v"))).alias("observed"), F.avg(drawn).alias("boot_mean"), F.percentile(drawn, F.array(F.lit(LOW), F.lit(HIGH))).alias("p"))
    return g.where("boot_mean IS NOT NULL").select("metric", "observed", "boot_mean", F.col("p")[0].alias("ci_lo"), F.col("p")[1].alias("ci_hi"))
