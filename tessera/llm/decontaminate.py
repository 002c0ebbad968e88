"""Operator 2: benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window). A window is a set of shingles of up to three words; a document that contains it contains all of
them, so under an order of the shingles by rarity the necessary prefix of a window is its rarest
shingle alone. Rarity is the number of documents with the shingle, counted over all documents; a
window with a shingle that stands in no document occurs nowhere and goes.

1. Items become a table of windows, and their shingles a table with document counts.
2. One pass over the documents emits the places of prefix shingles, each with the few words around it.
3. Places are joined with the windows of an equal prefix shingle. A place allows one start; the positional
   bound (it lies inside the document) and the length bound (so does the end) drop impossible ones, and
   the others are verified word by word.

Scale: two passes over the texts, which are never shuffled. What a task needs to know of the benchmark is a
bit filter of fixed size; windows, counts and places are tables that the planner joins by size, so the
benchmark may grow like the documents. Documents are told apart by 128 bits of (id, text).

Defined results: null or empty texts have no words, so nothing in them is hit, and null texts of items
have no windows; rows of one item id are one item; every document row has its own result, also
where ids are null or repeated with the same or another text; empty tables give an empty result or
all-clean rows. Windows of items without an id are hit like others: all such items together are one, which counts in the number
of items and has no name in their list. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import sieve
from tessera.llm import textkit as K
from tessera.llm.workspace import Workspace

WINDOW = 10
#: Words in a shingle; a window of fewer words is one shingle.
SHINGLE = 3


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(flat: np.ndarray, size: int) -> pa.Array:
    """Consecutive entries as lists of one size."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), _signed(flat))


def windows_of(bench: DataFrame, window: int) -> DataFrame:
    """(item, words, tokens) from (item, text): the word hashes of each window, and the hashes of its shingles in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        for b in it:
            for first, data, off in K.blocks(b.column(1)):
                h, edge, _ = K.words(data, off, table)
                names = b.column(0).slice(first, len(off) - 1)
                for r, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    n = min(window, e - s)
                    if n:
                        k = min(SHINGLE, n)
                        view = np.lib.stride_tricks.sliding_window_view
                        whole, parts = view(h[s:e], n), view(K.ngrams(h[s:e], k), n - k + 1)
                        at = np.unique(whole, axis=0, return_index=True)[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[r].as_py()] * len(at), pa.string()), _lists(np.ascontiguousarray(whole[at]).ravel(), n), _lists(np.ascontiguousarray(parts[at]).ravel(), n - k + 1)],
                            names=["item", "words", "tokens"],
                        )

    return bench.mapInArrow(run, "item string, words array<long>, tokens array<long>")


def _places(h: np.ndarray, edge: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number in the block, shingle, its size) of every shingle that the bit filter lets through."""
    out = []
    for k in range(1, SHINGLE + 1):
        g = K.ngrams(h, k)
        at = np.flatnonzero(sieve.passes(bits, g))
        row = np.searchsorted(edge, at, side="right") - 1
        inside = at + k <= edge[row + 1]
        at, row = at[inside], row[inside]
        out.append((row, at, g[at], np.full(len(at), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def document_counts(docs: DataFrame, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """(token, df): in how many rows each shingle of the vocabulary (token) stands. Counts are summed in each task first."""
    bits = sieve.bitmap(vocabulary, F.col("token"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        for b in it:
            for _, data, off in K.blocks(b.column(0)):
                h, edge, _ = K.words(data, off, table)
                row, _, token, _ = _places(h, edge, bits)
                order = np.lexsort((token, row))
                row, token = row[order], token[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
                token, count = np.unique(token[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(token), pa.array(count.astype(np.int64))], names=["token", "df"])

    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    return counted.join(vocabulary, "token", "left_semi")


def window_index(docs: DataFrame, bench: DataFrame, work: Workspace, window: int, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """The windows that can occur, (token, at, n, words, w1, w2) with the rarest shingle and its place, and (w1, w2, item): the items that hold them."""
    items = bench.select(bench[item_col].cast("string").alias("item"), bench[item_text_col].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    cut = work.save(windows_of(items, window).withColumns({"w1": F.xxhash64("words"), "w2": F.xxhash64(F.lit(2), "words")}), "windows")
    holders = cut.select("w1", "w2", "item").distinct()
    own = cut.select("w1", "w2", "words", "tokens").dropDuplicates(["w1", "w2"])
    vocabulary = work.save(cut.select(F.explode("tokens").alias("token")).distinct(), "vocabulary")
    counts = document_counts(docs, text_col, vocabulary)
    each = own.select("w1", "w2", F.posexplode("tokens").alias("at", "token")).join(counts, "token", "left")
    rare = each.groupBy("w1", "w2").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "at")).alias("x")).where("x.df > 0")
    index = own.drop("tokens").join(rare, ["w1", "w2"]).select("x.token", "x.at", F.size("words").alias("n"), "words", "w1", "w2")
    return work.save(index, "index"), holders


def _key(id_: Column, text: Column) -> list[Column]:
    t = text.cast("string")
    return [F.xxhash64(F.lit(1), id_, t).alias("k1"), F.xxhash64(F.lit(2), id_, t).alias("k2")]


def occurrences(docs: DataFrame, index: DataFrame, work: Workspace, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2, n_words) of every row, and (k1, k2, s, e, w1, w2) of every window found: words s to e of the row."""
    bits = sieve.bitmap(index, F.col("token"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
    schema = schema.add("n_words", T.LongType()).add("token", T.LongType()).add("pos", T.LongType()).add("left", T.IntegerType()).add("around", T.ArrayType(T.LongType()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.alnum_table()
        for b in it:
            for first, data, off in K.blocks(b.column(3)):
                h, edge, _ = K.words(data, off, table)
                rows = len(off) - 1
                part = [b.column(j).slice(first, rows) for j in range(3)]
                nothing = lambda t, n=rows: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(edge)), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int32()), nothing(pa.list_(pa.int64()))], names=schema.names)
                row, at, token, size = _places(h, edge, bits)
                for lo in range(0, len(row), 4096):
                    r, p, t, k = (x[lo : lo + 4096] for x in (row, at, token, size))
                    # a shingle of a short window is the whole of it
                    reach = np.where(k < SHINGLE, 0, window - k)
                    begin, end = np.maximum(edge[r], p - reach), np.minimum(edge[r + 1], p + k + reach)
                    span = end - begin
                    where = np.repeat(begin - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
                    around = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(span)]).astype(np.int32)), _signed(h[where]))
                    keys = [c.take(pa.array(r)) for c in part]
                    keys[0] = pa.nulls(len(r), part[0].type)
                    yield pa.RecordBatch.from_arrays([*keys, pa.nulls(len(r), pa.int64()), _signed(t), pa.array(p - edge[r]), pa.array((p - begin).astype(np.int32)), around], names=schema.names)

    seen = docs.select(docs[id_col].alias("id"), *_key(docs[id_col], docs[text_col]), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    seen = work.save(seen, "seen")
    rows = seen.where("token IS NULL").select("id", "k1", "k2", "n_words")
    places = seen.where("token IS NOT NULL").select("k1", "k2", "token", "pos", "left", "around")
    found = places.join(index, "token").where("left >= at AND left - at + n <= size(around)")
    found = found.where(F.slice("around", F.col("left") - F.col("at") + 1, F.col("n")) == F.col("words"))
    return rows, found.select("k1", "k2", (F.col("pos") - F.col("at")).alias("s"), (F.col("pos") - F.col("at") + F.col("n")).alias("e"), "w1", "w2").distinct()


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no window occurs. Only rows that a bit filter lets through are shuffled."""
    work = Workspace(docs.sparkSession, "leaks")
    index, _ = window_index(docs, bench, work, window, text_col, item_col, item_text_col)
    bad = work.save(occurrences(docs, index, work, window, id_col, text_col)[1].select("k1", "k2").distinct(), "bad")
    work.drop("windows", "vocabulary", "index", "seen")
    maybe, other = sieve.split(docs, _key(docs[id_col], docs[text_col])[0], bad, F.col("k1"))
    mine = _key(maybe[id_col], maybe[text_col])
    return maybe.join(bad, (mine[0] == bad["k1"]) & (mine[1] == bad["k2"]), "left_anti").select(*docs.columns).union(other)


def find_leaks(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, n_words, spans, items, unnamed) of every document row: hit word ranges, the sorted ids (as text) of the items found in it, and whether one without an id is."""
    work = Workspace(docs.sparkSession, "leaks")
    index, holders = window_index(docs, bench, work, window, text_col, item_col, item_text_col)
    rows, hits = occurrences(docs, index, work, window, id_col, text_col)
    hits = work.save(hits, "hits")
    # ranges that meet or overlap are one: a range begins where it starts after all earlier ends
    before = Window.partitionBy("k1", "k2").orderBy("s", "e")
    reach = F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    run = hits.select("k1", "k2", "s", "e").distinct().withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    span = run.groupBy("k1", "k2", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = span.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    held = hits.select("k1", "k2", "w1", "w2").distinct().join(holders, ["w1", "w2"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"), F.bool_or(F.col("item").isNull()).alias("unnamed"))
    out = rows.join(spans.join(held, ["k1", "k2"]), ["k1", "k2"], "left")
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("unnamed", F.lit(False)).alias("unnamed"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The findings as counts: n_words, n_hit, n_items, SHA-256 of the sorted item ids, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
