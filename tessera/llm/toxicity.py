"""Operator 7: toxicity by non-negative positive-unlabelled learning.

Features of a text are its words and word beginnings of 4 to 8 bytes, as hashes, each at the levels that
its count reaches: present, twice, four times, one word in 200, one in 60.
The model is linear over the features that tell the confirmed toxic texts from unlabelled ones, and
is trained in numpy on the class-prior-corrected risk
    prior * E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_toxic[loss(-)]),
stepping against the bracket where it falls below zero. The prior is the share of toxic rows among all
learnable labels. Scores are the logistic of the linear form.

Features are chosen by how often they stand in the confirmed texts and in all documents, both counted on the
executors; the driver gets the chosen ones, at most ``FEATURES``, and then one bit for each of them and sampled text.

Bounds: the fit uses at most ``MAX_TOXIC`` confirmed and ``MAX_UNLABELLED`` unlabelled ids (the least hashes), each
with one text, so what comes to the driver is at most 9,000 rows of 200 bytes whatever the input and the length of its
texts; the frequencies among the unlabelled are counted over all documents; every text is scored whole. Rows whose id has
crc32 = 2 modulo 4 lend no label.

Defined results: null and empty texts have no features and get the score of the bias; without any
confirmed example the score is 0 for every row; repeated rows score alike; empty tables give an
empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import sieve
from tessera.llm import textkit as K
from tessera.llm.labelled import held_out, sample_ids
from tessera.llm.workspace import Workspace

MAX_TOXIC, MAX_UNLABELLED = 3000, 6000
FEATURES = 1500
PREFIXES = (4, 5, 6, 7, 8)
#: A feature has to be toxic with at least this probability, from its frequencies and the prior.
MOSTLY = 0.5
#: Least log likelihood ratio of a feature; millions are looked at, so chance alone reaches some 15.
SURE = 12.0
THRESHOLD = 0.3


#: A count c among n words reaches level j where c >= LEAST[j] and c * PER[j] >= n.
LEAST, PER = (1, 2, 4, 1, 1), (1 << 40, 1 << 40, 1 << 40, 200, 60)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    base: np.ndarray


def levels(row: np.ndarray, key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, base hash) of every level that the counts in (row, base hash) pairs with repeats reach; words: by row."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(row)))
    row, key = row[at], key[at]
    out = []
    for j, (least, per) in enumerate(zip(LEAST, PER, strict=True)):
        on = (count >= least) & (count * per >= words[row])
        out.append((row[on], K.mix(key[on] ^ np.uint64(0x632BE59BD9B4E019 * (j + 1) & 0xFFFFFFFFFFFFFFFF)), key[on]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def row_features(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, base hash) pairs of a block, with repeats, and the number of words of each row."""
    w = K.Words(data, off, table)
    row = np.repeat(np.arange(len(off) - 1), np.diff(w.edge))
    rows, keys = [row], [w.hashes()]
    for size in PREFIXES:
        at, h = w.prefixes(size)
        rows.append(row[at])
        keys.append(h)
    return np.concatenate(rows), np.concatenate(keys), np.diff(w.edge)


def feature_counts(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(key, base, n): in how many rows of (text) each feature stands. only: a bit filter of the stems to look at."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        for b in it:
            for _, data, off in K.blocks(b.column(0)):
                row, h, size = row_features(data, off, table)
                if only is not None:
                    some = sieve.passes(only, h)
                    row, h = row[some], h[some]
                _, key, base = levels(row, h, size)
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(base[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "base", "n"])

    return texts.mapInArrow(run, "key long, base long, n long").groupBy("key").agg(F.min("base").alias("base"), F.sum("n").alias("n"))


def choose_features(toxic: DataFrame, n_toxic: int, other: DataFrame, n_other: int, prior: float, limit: int = FEATURES) -> DataFrame:
    """(key, base): the features that make toxicity more likely than not and differ most surely between both sides (likelihood ratio).

    Weaker signs are left out: they tell languages and sources apart rather than toxic texts.
    """
    n, m = F.lit(float(n_toxic)), F.lit(float(max(1, n_other)))
    d = toxic.where(F.col("n") >= max(3, n_toxic // 400)).select("key", "base", F.col("n").cast("double").alias("a"))
    d = d.join(other.select("key", F.col("n").cast("double").alias("b")), "key", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))

    def ll(x: Column, size: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return x * F.log(p) + (size - x) * F.log(1 - p)

    a, b = F.col("a"), F.col("b")
    pool = (a + b) / (n + m)
    d = d.where(F.lit(prior) * a / n >= F.lit(MOSTLY) * b / m).withColumn("gain", ll(a, n, a / n) + ll(b, m, b / m) - ll(a, n, pool) - ll(b, m, pool))
    return d.where(F.col("gain") > SURE).orderBy(F.desc("gain"), "key").limit(limit).select("key", "base")


def _present(texts: DataFrame, keys: np.ndarray, base: np.ndarray) -> DataFrame:
    """(kind, id, bits) from (kind, id, text): which of the sorted keys stand in each text."""
    stems = np.unique(base)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        for b in it:
            for first, data, off in K.blocks(b.column(2)):
                n = len(off) - 1
                row, h, size = row_features(data, off, table)
                at = np.searchsorted(stems, h)
                at[at == len(stems)] = 0
                some = stems[at] == h
                row, key, _ = levels(row[some], h[some], size)
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = keys[at] == key
                on = np.zeros((n, len(keys)), bool)
                on[row[hit], at[hit]] = True
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array([r.tobytes() for r in np.packbits(on, axis=1)], pa.binary())], names=["kind", "id", "bits"])

    return texts.mapInArrow(run, T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", texts.schema["id"].dataType), T.StructField("bits", T.BinaryType())]))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int = 300, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear model of 0/1 features by full-batch Adam on the non-negative risk. xp: confirmed rows, xu: unlabelled ones."""
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    xp, xu = xp.astype(np.float32), xu.astype(np.float32)
    m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        _, (g, gb) = risk(xp, xu, w, b, prior)
        g = g + decay * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - step * m1 / (np.sqrt(m2) + 1e-8)
        b -= step * c1 / (np.sqrt(c2) + 1e-8)
    return w, b


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, tuple[np.ndarray, float]]:
    """The non-negative risk under the logistic loss, and the direction to descend: its gradient, or the bracket's reversed where that is negative."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    fp, fu = xp @ w.astype(xp.dtype) + b, xu @ w.astype(xu.dtype) + b
    n, m = max(1, len(fp)), max(1, len(fu))
    # loss(+)(f) = log(1 + exp(-f)) with slope -sig(-f); loss(-)(f) = log(1 + exp(f)) with slope sig(f)
    bracket = np.logaddexp(0, fu).sum() / m - prior * np.logaddexp(0, fp).sum() / n
    value = prior * np.logaddexp(0, -fp).sum() / n + max(0.0, bracket)
    inside_p, inside_u = -prior * sig(fp) / n, sig(fu) / m
    dp, du = (-prior * sig(-fp) / n + inside_p, inside_u) if bracket >= 0 else (-inside_p, -inside_u)
    return float(value), (xp.T @ dp.astype(xp.dtype) + xu.T @ du.astype(xu.dtype), float(dp.sum() + du.sum()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """None without a confirmed example. Ids of the samples are broadcast: their number is bounded by the parameters."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(label_col), F.lit(0))).first()
    if not toxic:
        return None
    work = Workspace(docs.sparkSession, "toxicity")
    pos = sample_ids(known.where(F.col(label_col) == 1), id_col, max_toxic, 1).withColumn("kind", F.lit(1))
    any_ = sample_ids(docs, id_col, max_unlabelled, 2).withColumn("kind", F.lit(0))
    chosen = pos.union(any_).withColumnRenamed(id_col, "id")
    every = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    texts = every.join(F.broadcast(chosen), "id").groupBy("kind", "id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    texts = work.save(texts, "texts")
    n_toxic = texts.where("kind = 1").count()
    if not n_toxic:
        work.close()
        return None
    prior = min(max(toxic / n, 1e-3), 0.5)
    of_toxic = work.save(feature_counts(texts.where("kind = 1").select("text")).where(F.col("n") >= max(3, n_toxic // 400)), "toxic")
    of_all = feature_counts(every.select("text"), sieve.bitmap(of_toxic, F.col("base")))
    got = choose_features(of_toxic, n_toxic, of_all, every.count(), prior).toArrow()
    keys, base = (got[c].to_numpy().view(np.uint64) for c in ("key", "base"))
    order = np.argsort(keys)
    keys, base = keys[order], base[order]
    if not len(keys):
        work.close()
        return Model(keys, np.empty(0), float(np.log(prior / (1 - prior))), keys)
    rows = _present(texts, keys, base).toArrow().sort_by([("kind", "ascending"), ("id", "ascending")])
    work.close()
    x = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(keys)]
    kind = rows["kind"].to_numpy()
    weights, bias = fit(x[kind == 1], x[kind == 0], prior)
    return Model(keys, weights, bias, np.unique(base))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    key = docs.schema[id_col].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        quick = np.zeros(1 << 16, bool)
        if model:
            quick[(model.base & np.uint64(0xFFFF)).astype(np.int64)] = True
        for b in it:
            for first, data, off in K.blocks(b.column(1)):
                n = len(off) - 1
                z = np.full(n, model.bias if model else -np.inf)
                if model and len(model.keys):
                    row, h, size = row_features(data, off, table)
                    some = quick[(h & np.uint64(0xFFFF)).astype(np.int64)]
                    row, h, _ = levels(row[some], h[some], size)
                    at = np.searchsorted(model.keys, h)
                    at[at == len(model.keys)] = 0
                    hit = model.keys[at] == h
                    z += np.bincount(row[hit], weights=model.weights[at[hit]], minlength=n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))) if model else np.zeros(n))], names=["id", "score"])

    schema = T.StructType([T.StructField("id", key), T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs."""
    s = score(docs, train(docs, labels, id_col), id_col)
    return s.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
