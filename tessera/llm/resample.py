"""Operator 11: target-distribution importance resampling over a dictionary of distinct features.

Features are all runs of 1 to ``LONGEST`` words. The features of the raw texts and of the target texts are counted as strings
in one dictionary; each of its distinct strings is hashed once, to one of ``BUCKETS`` buckets, and the counts are summed by
bucket. A bucket's gain is the log ratio of its smoothed frequencies in target and raw texts. A document's weight is the
mean gain of its features, and Gumbel noise from its id turns the weights into a draw without replacement: the rows of
the highest sums are the sample.

1. One pass over the texts counts, in blocks of ``BLOCK`` bytes, the distinct strings of each block; the counts meet by string.
   Words and pairs are numbered within a block, so a string is built once for all its places there. The strings of a block that go
   to one slot of the shuffle travel in one row.
2. The dictionary is aggregated by bucket: at most ``BUCKETS`` rows, which is all the driver ever gets of it.
3. A second pass numbers the features of a block again, looks each distinct one's gain up, and sums over documents.
   A block's distinct strings are hashed once there too: joining documents and dictionary on the string instead would
   shuffle every string of every block twice more.
4. The rows are numbered by score over range partitions, so no task sorts them all.

Scale: only the (string, count) pairs of blocks and one narrow row for each document are shuffled.

Defined results: null and empty texts have no features and weight 0; a null id counts as an empty one in the noise and comes after
all ids in ties; rows with an equal id are drawn separately, as they stand; without target texts the gains
follow from empty counts; empty tables give an empty result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkit as K
from tessera.llm.workspace import Workspace
from tessera.operators.rownumbers import number_rows

LONGEST, BUCKETS = 2, 10_000
#: Bytes of text whose features share one dictionary in a task; a longer text has its own.
BLOCK = 4 << 20
#: Least number of slots that strings are dealt to; there are four for each shuffle partition at least.
SLOTS = 4096
SHARE, MIN_WORDS, SEED = 25, 20, 7


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each entry among the distinct ones, distinct entries)."""
    d = pa.array(x).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_numpy()


def block_features(data: np.ndarray, off: np.ndarray, table: np.ndarray, longest: int, keyed: bool = False) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(distinct strings, number of each place's string, row of each place, words of each row, a key of each string if asked for) of the runs of 1, 2, ... words of a block."""
    w = K.Words(data, off, table)
    n = np.diff(w.edge)
    row = np.repeat(np.arange(len(n)), n)
    if not len(w.s):
        return
    encoded = w.strings().dictionary_encode()
    words, number = encoded.dictionary, encoded.indices.to_numpy()
    text, at, own, key, word_key = words, number, row, None, None
    if keyed:
        key = word_key = np.empty(len(words), np.uint64)
        word_key[number[::-1]] = w.hashes()[::-1]
    yield text, at, own, n, key
    for k in range(2, longest + 1):
        # a run of k words is one of k - 1 and the next word, where that is in the same row
        inside = own[: len(row) - k + 1] == row[k - 1 :]
        code = at[: len(row) - k + 1].astype(np.int64) * len(words) + number[k - 1 :]
        at, pairs = _coded(np.where(inside, code, -1))
        made = pc.binary_join_element_wise(text.take(pa.array(np.maximum(pairs, 0) // len(words))), words.take(pa.array(np.maximum(pairs, 0) % len(words))), " ")
        text, own = made, np.where(inside, own[: len(inside)], -1)
        if keyed:
            with np.errstate(over="ignore"):
                key = K.mix(key[np.maximum(pairs, 0) // len(words)] * np.uint64(0x9E3779B97F4A7C15) + word_key[np.maximum(pairs, 0) % len(words)])
        # entries that no row has, where a run would cross rows, stay in place so that longer runs line up
        used = np.flatnonzero(pairs >= 0)
        renumber = np.full(len(pairs), -1)
        renumber[used] = np.arange(len(used))
        yield text.take(pa.array(used)), renumber[at[inside]], own[inside], n, key[used] if keyed else None


def packed_counts(texts: DataFrame, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(slot, features, counts) from (text): the distinct strings of each block that go to a slot, a line each, and how often each stands in the block."""
    spark = texts.sparkSession
    slots = max(SLOTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        for b in it:
            for _, data, off in K.blocks(b.column(0), block):
                for text, at, _, _, key in block_features(data, off, table, longest, keyed=True):
                    slot = (key % np.uint64(slots)).astype(np.int32)
                    order = np.argsort(slot, kind="stable")
                    first = np.flatnonzero(np.diff(slot[order], prepend=-1))
                    edge = pa.array(np.append(first, len(order)).astype(np.int32))
                    lists = pa.ListArray.from_arrays(edge, text.take(pa.array(order)).cast(pa.string()))
                    counts = pa.ListArray.from_arrays(edge, pa.array(np.bincount(at, minlength=len(text))[order].astype(np.int64)))
                    # no word holds a line feed
                    yield pa.RecordBatch.from_arrays([pa.array(slot[order][first]), pc.binary_join(lists, "\n"), counts], names=["slot", "features", "counts"])

    return texts.mapInArrow(run, "slot int, features string, counts array<long>")


def dictionary(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(feature, raw, target, bucket): every distinct feature once, its counts on both sides, and its bucket."""
    texts = docs.select(docs[text_col].cast("string").alias("text")), target.select(target[target_col].cast("string").alias("text"))
    packed = [packed_counts(t, longest).withColumn("side", F.lit(k)) for k, t in enumerate(texts)]
    dealt = packed[0].union(packed[1]).repartition("slot")  # every string has one slot, so its rows need not move again
    each = dealt.select("slot", "side", "counts", F.posexplode(F.split("features", "\n")).alias("k", "feature"))
    each = each.select("slot", "side", "feature", F.get("counts", F.col("k")).alias("n"))
    of = lambda k: F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0))
    d = each.groupBy("slot", "feature").agg(of(0).alias("raw"), of(1).alias("target")).drop("slot")
    return d.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))


def bucket_gains(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from the dictionary summed by bucket."""
    got = features.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = got["bucket"].to_numpy()
    raw[at], target[at] = got["raw"].to_numpy(), got["target"].to_numpy()
    s_all, t_all = int(raw.sum()), int(target.sum())
    gain = lambda s, t: math.floor(1000 * math.log((float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))))
    return np.array([gain(s, t) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the mean gain of its features, rounded down."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        for b in it:
            for first, data, off in K.blocks(b.column(1), block):
                rows = len(off) - 1
                total, count, words = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for text, at, row, n, _ in block_features(data, off, table, longest):
                    words = n
                    bucket = np.fromiter((zlib.crc32(x) for x in text.cast(pa.binary()).to_pylist()), np.int64, len(text)) % len(gains)
                    # places stand in the order of rows
                    edge = np.searchsorted(row, np.arange(rows + 1))
                    run_ = np.concatenate([[0], np.cumsum(gains[bucket][at])])
                    total += run_[edge[1:]] - run_[edge[:-1]]
                    count += np.diff(edge)
                mean = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), *[pa.array(x.astype(np.int64)) for x in (words, count, mean)]], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank numbers the drawn ones, ``share`` percent of those with at least ``min_words`` words, by score."""
    work = Workspace(docs.sparkSession, "resample")
    gains = bucket_gains(dictionary(docs, target, text_col, target_col))
    scored = weights(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    scored = work.save(scored, "scored")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * share // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    ranked = number_rows(scored.where(able), order, name="rank", keep=lambda d: work.save(d, "ordered"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.union(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select(id_col, "n_features", "weight", "score", "rank")


def duckdb_sql() -> str:
    """The same result in SQL."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    words = lambda t, k: rf"SELECT {k} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {t}"
    return rf"""
WITH dw AS ({words("documents", "doc_id")}), bw AS ({words("benchmark", "item_id")}),
d AS (SELECT row_number() OVER () AS r, * FROM dw),
df AS (SELECT r, array_to_string(w[i : i + k - 1], ' ') AS f FROM d, (VALUES (1), (2)) AS s(k), unnest(range(1, len(w) - k + 2)) AS q(i) WHERE len(w) >= k),
bf AS (SELECT array_to_string(w[i : i + k - 1], ' ') AS f FROM bw, (VALUES (1), (2)) AS s(k), unnest(range(1, len(w) - k + 2)) AS q(i) WHERE len(w) >= k),
dict AS (SELECT f, sum(s) AS s, sum(t) AS t, hex(encode(f)) AS h FROM (SELECT f, 1 AS s, 0 AS t FROM df UNION ALL SELECT f, 0, 1 FROM bf) GROUP BY f),
crc(tab) AS (VALUES ({table})),
hashed AS (
  SELECT f, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS BIGINT))),
    lambda a, b: xor(a // 256, tab[1 + xor(a % 256, b)]))) % {BUCKETS} AS bucket FROM dict, crc
), sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
whole AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln(((sums.t + 1) * (whole.s + {BUCKETS})) / ((sums.s + 1) * (whole.t + {BUCKETS})))) AS g FROM sums, whole),
mean AS (SELECT r, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
sc AS (
  SELECT id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (r)
), rk AS (SELECT *, CASE WHEN n_words >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, id NULLS LAST, n_features, weight) END AS r, count(*) FILTER (WHERE n_words >= {MIN_WORDS}) OVER () AS n FROM sc)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN r <= {SHARE} * n // 100 THEN r END AS rank FROM rk
"""
