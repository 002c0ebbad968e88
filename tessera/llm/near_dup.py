"""Operator 5: near-duplicate documents by MinHash, banding, verification and star contraction.

1. One pass over the texts gives each document's set of word shingles as 64-bit hashes, reduced at
   once to a fingerprint of the set, ``bands * rows`` minima under universal hash functions, and a
   key for each band of ``rows`` minima. Equal sets share a fingerprint and are one node from here on,
   so thousands of exact copies cost one row.
2. Nodes that share a band key are candidates. A bucket is tested as a star: every member
   against its smallest member, on the full sets. Confirmed links are contracted to components.
3. What the stars cannot settle is settled exactly, without pairing a bucket's members. Two members
   of one bucket from different components are linked only if they share a shingle of their prefixes: the first
   n - ceil(0.8 n) + 1 shingles of a set in one order, here those that the centre lacks before those that it has.
   So members that have little but the centre's text in common are out. Those that are left meet within their
   bucket and have to pass bounds by set size, by their distances to the centre (Jaccard distance is a metric) and by
   bitmaps: sets folded by parity differ in no more bits than elements. What passes is confirmed on the
   full sets, and the components follow from all links.

With the defaults (48 bands of 6 minima) a pair at exactly 0.8 shares no band with probability
(1 - 0.8**6)**48 = 5e-7, and fewer above it.

Scale: text is read in two passes; only texts that a bit filter lets through are shuffled, to meet the keys
of candidates; buckets shuffle 16 bytes a band; no list of a bucket's members is ever gathered; hubs are salted.

Defined results: a document without words (null, empty, white space) has an empty set, is linked with
nothing and is its own component; a row repeating another's id and text gets the same result; rows
that repeat an id with another text are nodes of their own, each in the component of its own text. A null id is never
a component's name where the component has another id; in a component without any id the component is null and
the rows of one of its texts (that of the least fingerprint) are kept. An empty table gives an empty result.
Extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sieve
from tessera.llm import textkit as K
from tessera.llm.components import MAX_ROUNDS, SALTS, connected_components
from tessera.llm.workspace import Workspace

BANDS, ROWS = 48, 6
#: Bits of a parity bitmap. Longer sets fill it and are then told apart by their full sets alone.
BITS = 4096


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, one after another; row edges)."""
    h, edge, _ = K.words(data, off, K.space_split_table())
    grams = K.ngrams(h, size)
    out, ends = [], [0]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            s = np.sort(grams[a : b - size + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            s = K.ngrams(h[a:b], n, seed=1 << 20)
        else:
            s = grams[:0]
        out.append(s)
        ends.append(ends[-1] + len(s))
    return (np.concatenate(out) if out else grams[:0]), np.array(ends)


def _sketch(sets: np.ndarray, edge: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a set, two fingerprint halves, band keys) from the sets of all rows."""
    some = np.flatnonzero(np.diff(edge))
    at = edge[some]
    with np.errstate(over="ignore"):
        f1 = np.add.reduceat(K.mix(sets ^ np.uint64(0x1B873593CC9E2D51)), at) if len(some) else sets[:0]
        f2 = np.add.reduceat(K.mix(sets ^ np.uint64(0x52DCE729DA3ED6D3)), at) if len(some) else sets[:0]
        factor = K._splitmix(2 * bands * rows, 99)
        least = np.empty((len(some), bands * rows), np.uint64)
        # a slice of sets that stays in the cache, under all functions; a set may span slices
        step = 1 << 15
        least.fill(np.uint64(0xFFFFFFFFFFFFFFFF))
        buf = np.empty(step, np.uint64)
        for lo in range(0, len(sets), step):
            x = sets[lo : lo + step]
            r0 = int(np.searchsorted(at, lo, side="right")) - 1
            r1 = int(np.searchsorted(at, lo + len(x), side="left"))
            cut = np.maximum(at[r0:r1] - lo, 0)
            part = least[r0:r1]
            v = buf[: len(x)]
            for j in range(bands * rows):
                np.multiply(x, factor[2 * j] | np.uint64(1), out=v)
                np.add(v, factor[2 * j + 1], out=v)
                np.minimum(part[:, j], np.minimum.reduceat(v, cut), out=part[:, j])
        key = np.broadcast_to(K._splitmix(bands, 7), (len(some), bands)).copy()
        shaped = least.reshape(len(some), bands, rows)
        for j in range(rows):
            key = K.mix(key * np.uint64(K._BASE) + shaped[:, :, j])
    return some, f1, f2, key


def _keys(id_: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), id_, text).alias("k1"), F.xxhash64(F.lit(2), id_, text).alias("k2")]


def sketches(df: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, n, f1, f2, bands) from (doc_id, k1, k2, text); fingerprint and bands are null for an empty set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, data, off in K.blocks(b.column(3)):
                sets, edge = shingle_sets(data, off, size)
                some, f1, f2, key = _sketch(sets, edge, bands, rows)
                n = np.diff(edge)
                empty = n == 0
                full1, full2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                full1[some], full2[some] = f1.view(np.int64), f2.view(np.int64)
                count = np.where(empty, 0, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(key.view(np.int64).ravel()))
                own = [b.column(j).slice(first, len(n)) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(full1, mask=empty), pa.array(full2, mask=empty), lists], names=["doc_id", "k1", "k2", "n", "f1", "f2", "bands"])

    return df.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, f1 long, f2 long, bands array<long>")


def _parity(sets: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A bitmap of each set: a bit tells whether an odd number of its elements fall on it."""
    bit = (sets >> np.uint64(52)).astype(np.int64) % BITS
    odd = np.zeros((len(edge) - 1, BITS), np.uint8)
    for r, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        odd[r] = np.bincount(bit[a:b], minlength=BITS) & 1
    return np.packbits(odd, axis=1).view(np.int64)


def full_sets(df: DataFrame, size: int) -> DataFrame:
    """(v, s, bits) from (v, text): the sorted distinct shingle hashes and their parity bitmap."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, data, off in K.blocks(b.column(1)):
                sets, edge = shingle_sets(data, off, size)
                bits = _parity(sets, edge)
                lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(sets.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)), pa.array(bits.ravel()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(off) - 1), *lists], names=["v", "s", "bits"])

    return df.mapInArrow(run, "v long, s array<long>, bits array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with both sets."""
    left, right = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    return pairs.join(right, "b").join(left, "a")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with i, na, nb: the sizes of their intersection and of both sets."""
    return _with_sets(pairs, sets).select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"))


def prefix(centre: Column, own: Column, percent: int) -> Column:
    """The shingles of a set that come first in the order of its bucket, one of which it shares with every set linked with it."""
    n = F.size(own)
    return F.slice(F.concat(F.array_except(own, centre), F.array_intersect(own, centre)), F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))


def _meetings(unsettled: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Pairs (a, b) of different components g among one centre's rows (c, v, n, d, g) that can be linked, by prefixes, sizes, distances and bitmaps."""
    both = _with_sets(unsettled.withColumnsRenamed({"c": "a", "v": "b"}), sets)
    tokens = both.select(F.col("a").alias("c"), F.col("b").alias("v"), "n", "d", "g", F.explode(prefix(F.col("sa"), F.col("sb"), percent)).alias("token"))
    tokens = work.save(tokens, "tokens")
    shared = tokens.groupBy("c", "token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("c", "token")
    some = tokens.join(shared, ["c", "token"], "left_semi").select("c", "v", "n", "d", "g").distinct()
    some = work.save(some.join(sets.select("v", "bits"), "v"), "open")
    work.drop("tokens")
    x, y = some.alias("x"), some.alias("y")
    may = F.expr(f"x.c = y.c AND x.g < y.g AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND abs(x.d - y.d) <= {1 - percent / 100 + 1e-9}")
    apart = F.aggregate(F.zip_with("x.bits", "y.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    may = may & (apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent))
    return x.join(y, may).select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()


def document_classes(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept) of every row of docs; k1 and k2 stand for the id and the text."""
    work = Workspace(spark, "near-dup")
    id_, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    texts = docs.select(id_.alias("doc_id"), *_keys(id_, text), text.alias("text"))
    sk = work.save(sketches(texts, size, bands, rows), "sketches")

    # one node for each distinct set, with the row that stands for it
    node = sk.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    node = work.save(node.select("f1", "f2", "first", "k.k1", "k.k2", "n", "bands", F.monotonically_increasing_id().alias("v")), "nodes")
    in_band = node.select("v", "n", F.explode("bands").alias("key"))
    centre = work.save(in_band.groupBy("key").agg(F.min("v").alias("c"), F.max("v").alias("last")).where("c < last").select("key", "c"), "centres")
    members = work.save(in_band.join(centre, "key").select("c", "v", "n").distinct(), "members")

    stars = members.where("v <> c").select(F.col("c").alias("a"), F.col("v").alias("b"))
    near = work.save(members.select("v").distinct().join(node.select("v", "k1", "k2"), "v"), "near")
    maybe, _ = sieve.split(texts, F.col("k1"), near, F.col("k1"))
    asked = maybe.join(near, ["k1", "k2"]).select("k1", "k2", "v", "text").dropDuplicates(["k1", "k2"])
    sets = work.save(full_sets(asked.select("v", "text"), size), "sets")
    star = work.save(_confirm(stars, sets), "stars")
    linked = F.expr(f"100 * i >= {percent} * (na + nb - i)")
    links = work.save(star.where(linked).select("a", "b"), "links")
    label = connected_components(links, work, "cc-stars")

    # members of one centre that are still apart
    dist = star.select(F.col("a").alias("c"), F.col("b").alias("v"), F.col("nb").alias("n"), (1 - F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("d"))
    m = work.save(dist.join(label.withColumnRenamed("node", "v"), "v", "left").select("c", "v", "n", "d", F.coalesce("component", "v").alias("g")), "apart")
    work.drop("stars", "members", "centres")
    mixed = m.groupBy("c").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("c")
    rest = work.save(_meetings(m.join(mixed, "c", "left_semi"), sets, percent, work), "rest")
    more = work.save(_confirm(rest, sets).where(linked).select("a", "b"), "more")
    final = connected_components(links.union(more), work, "cc-all")

    # a component's name is its smallest id; without any id its least fingerprint stands for it. Large components are dealt over salts
    salt = F.pmod(F.hash("v"), F.lit(SALTS)).alias("salt")
    final = final.select(F.col("node").alias("v"), "component", salt)
    best = final.join(node.select("v", "first", "f1", "f2"), "v").groupBy("component").agg(F.min("first").alias("component_id"), F.min(F.struct("f1", "f2")).alias("least"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = node.select("f1", "f2", "first", "v").join(final.join(best, ["component", "salt"]).select("v", "component", "component_id", "least"), "v", "left")
    alone = F.col("component").isNull()
    named = named.select("f1", "f2", F.when(alone, F.col("first")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.struct("f1", "f2") == F.col("least"))).alias("is_least"))
    out = sk.select("doc_id", "k1", "k2", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    comp = F.when(F.col("f1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == comp, comp.isNull() & F.coalesce("is_least", F.lit(True)))
    out = work.save(out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), comp.alias("component_id"), kept.alias("kept")), "result")
    work.drop("sketches", "nodes", "near", "sets", "links", "apart", "open", "rest", "more", *(f"cc-{x}-{k}" for x in ("stars", "all") for k in range(MAX_ROUNDS)))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    size: words in a shingle. percent: documents are linked where 100 * intersection >= percent * union.
    """
    return document_classes(spark, docs, size, percent, bands, rows, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Only rows that a bit filter lets through are shuffled."""
    gone = Workspace(spark, "near-dup").save(document_classes(spark, docs, size, percent, id_col=id_col, text_col=text_col).where("NOT kept").select("k1", "k2").distinct(), "gone")
    mine = lambda d: _keys(d[id_col].cast("long"), d[text_col].cast("string"))
    maybe, other = sieve.split(docs, mine(docs)[0], gone, F.col("k1"))
    key = mine(maybe)
    left = maybe.join(gone, (key[0] == gone["k1"]) & (key[1] == gone["k2"]), "left_anti")
    return left.select(*docs.columns).union(other)
