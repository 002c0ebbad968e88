"""Operator 8: text quality by a regularised quadratic discriminant.

Each text is reduced to a few statistics (shares of symbols, capitals, bars, exclamation marks,
repeated words, word pairs and word fives, ...), transformed to be roughly normal. Every class has
its own covariance, shrunk towards the diagonal of the pooled one; the score is the logistic of the
difference of the two log densities, each from the Mahalanobis distance under a cached Cholesky
factor, plus the log odds of the classes.

Bounds: the fit uses the statistics of at most ``MAX_ROWS`` labelled rows (least hashes of their ids);
every text is measured and scored whole. A sampled id that is repeated counts once, with its least label and statistics, and
rows are taken in the order of their ids, so that the scores are the same on every run. Rows whose id has crc32 = 2 modulo 4 lend no label.

Defined results: null and empty texts have the statistics of no words; if a class has no labelled
row, every score is the other class's (1 or 0), or 0.5 without any label; repeated rows score alike;
empty tables give an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkit as K
from tessera.llm.labelled import held_out, sample_ids
from tessera.llm.workspace import Workspace

MAX_ROWS = 20_000
SHRINK, FLOOR = 0.1, 0.05
THRESHOLD = 0.7
NAMES = ("log_words", "word_length", "symbols", "capitals", "bars", "exclaims", "digits", "same_as_before", "repeated_words", "repeated_pairs", "repeated_fives", "log_line_words", "other_scripts")


def _class_tables() -> dict[str, np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        t = np.zeros(256, np.int32)
        t[list(chars)] = 1
        return t

    high = np.zeros(256, np.int32)
    high[128:] = 1
    return {"symbols": of(b"#*$%&<>@~^=_"), "capitals": of(bytes(range(65, 91))), "bars": of(b"|"), "exclaims": of(b"!?"), "digits": of(bytes(range(48, 58))), "lines": of(b"\n"), "other": high}


def _repeated(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Share of entries of h[begin:end] that stand there already, for each row."""
    out = np.zeros(len(begin))
    for r, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            out[r] = np.count_nonzero(s[1:] == s[:-1]) / (b - a)
    return out


def measure(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics of each row, in the order of NAMES."""
    rows = len(off) - 1
    w = K.Words(data, off, K.space_split_table())
    h, edge = w.hashes(), w.edge
    n = np.diff(edge).astype(float)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(off), 1).astype(float)
    run = {k: np.concatenate([[0], np.cumsum(t[data])]) for k, t in _class_tables().items()}
    count = {k: (v[off[1:]] - v[off[:-1]]).astype(float) for k, v in run.items()}
    letters = np.concatenate([[0], np.cumsum(w.e - w.s + 1)])
    length = (letters[edge[1:]] - letters[edge[:-1]]) / some
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]))]) if len(h) else np.zeros(1)
    inner = np.where(n > 0, same[edge[1:]] - same[np.minimum(edge[:-1] + 1, len(h))], 0)
    g2, g5 = K.ngrams(h, 2), K.ngrams(h, 5)
    share = lambda x: np.log(x + 0.01)
    out = np.empty((rows, len(NAMES)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.log1p(length)
    for j, k in enumerate(("symbols", "capitals", "bars", "exclaims", "digits")):
        out[:, 2 + j] = share(count[k] / size)
    out[:, 7] = share(inner / some)
    out[:, 8] = _repeated(h, edge[:-1], edge[1:])
    out[:, 9] = share(_repeated(g2, edge[:-1], np.maximum(edge[1:] - 1, edge[:-1])))
    out[:, 10] = share(_repeated(g5, edge[:-1], np.maximum(edge[1:] - 4, edge[:-1])))
    out[:, 11] = np.log1p(n / (count["lines"] + 1))
    out[:, 12] = share(count["other"] / size)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) with x the statistics of each text."""
    key = docs.schema[id_col].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, data, off in K.blocks(b.column(1)):
                x = measure(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(x)), lists], names=["id", "x"])

    schema = T.StructType([T.StructField("id", key), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass
class Discriminant:
    """Means, Cholesky factors and log weights of the classes 0 and 1; constant if a class is missing. The factors are inverted once."""

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    log_weight: list[float]
    constant: float | None = None

    def __post_init__(self):
        self.inverse = [np.linalg.inv(f) for f in self.factor]
        self.log_det = [float(np.log(np.diag(f)).sum()) for f in self.factor]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = []
        for m, inverse, det, c in zip(self.mean, self.inverse, self.log_det, self.log_weight, strict=True):
            z = inverse @ (x - m).T
            log.append(c - det - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK, floor: float = FLOOR) -> Discriminant:
    parts = [x[y == c] for c in (0, 1)]
    if not len(parts[0]) or not len(parts[1]):
        return Discriminant([], [], [], 0.5 if not len(x) else float(bool(len(parts[1]))))
    pooled = sum(((p - p.mean(axis=0)) ** 2).sum(axis=0) for p in parts) / len(x) + floor**2
    mean, factor, weight = [], [], []
    for p in parts:
        m = p.mean(axis=0)
        cov = (p - m).T @ (p - m) / max(1, len(p) - 1)
        a = max(shrink, min(1.0, x.shape[1] / len(p)))
        mean.append(m)
        factor.append(np.linalg.cholesky((1 - a) * cov + a * np.diag(pooled)))
        weight.append(float(np.log(len(p) / len(x))))
    return Discriminant(mean, factor, weight)


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs."""
    stats = Workspace(spark, "quality").save(statistics(docs, id_col), "statistics")
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    # one row for each id, however often it is repeated
    chosen = known.join(sample_ids(known, id_col, max_rows, 3), id_col, "left_semi").groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    rows = stats.join(chosen, id_col).groupBy(id_col).agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow().sort_by(id_col)
    y = rows["y"].to_numpy()
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), len(NAMES))
    model = fit(x, y)
    key = docs.schema[id_col].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(v))], names=["id", "score"])

    s = stats.mapInArrow(run, T.StructType([T.StructField("id", key), T.StructField("score", T.DoubleType())]))
    return s.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
