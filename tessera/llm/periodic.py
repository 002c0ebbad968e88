"""Operator 12: periodic runs of words by harmonic grid probing.

A run is a stretch of consecutive words with smallest period p (words p apart are equal), of at least ``MIN_LENGTH`` words
and two periods, that no neighbouring word extends. Its equal pairs (i, i + p) form a stretch of at least p places, which
holds a multiple of p. So for every period p only the places 0, p, 2p, ... are probed: word jp against word (j + 1)p, n ln n
probes for a text of n words. A probe that hits is held against a few places around it, of which all on one side must be equal in a
run; what survives is extended by comparing chunks of the text with itself p words on. Grid points within a stretch
already extended are skipped, and so are those within a found run whose period divides p: there the stretch is that run.
Where many points of one period survive, their stretches are read off one comparison of the whole text.

The work is one pass over each text within its task; nothing is shuffled. Words are compared by numbers that stand for the
distinct words of a block, not by hashes. Time of ordinary texts grows with n ln n, that of the worst with n * n / 2 vectorised
comparisons; grid points are taken in portions of at most ``PROBES``, so memory stays in proportion to the text.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; each row is scanned by itself, so
repeated rows have equal results; empty tables give an empty result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkit as K

MIN_LENGTH = 12
#: Grid points probed in one step.
PROBES = 1 << 20
#: Texts up to this many words keep their grid between calls.
REMEMBERED = 1024
#: First chunk of an extension; each next one is twice as long.
CHUNK = 64

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _points(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, jp) of every grid point of a text of n words with low <= p < high, where (j + 1)p is a word too."""
    p = np.arange(low, high, dtype=np.int64)
    count = (n - 1) // p
    first = np.cumsum(count) - count
    every = np.repeat(p, count)
    return every, (np.arange(len(every)) - np.repeat(first, count)) * every


@lru_cache(maxsize=REMEMBERED)
def _small_grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, i = _points(n, 1, n // 2 + 1)
    return p.astype(np.int32), i.astype(np.int32)


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grid points of a text in portions, by period and place."""
    if n <= REMEMBERED:
        yield _small_grid(n)
        return
    low = 1
    while low <= n // 2:
        # periods low..high have at most (high - low) * (n / low) points
        high = min(n // 2 + 1, low + max(1, PROBES * low // n))
        yield _points(n, low, high)
        low = high


def _survivors(w: np.ndarray, p: np.ndarray, i: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points whose own pair is equal, and a few more pairs up to half the least stretch on one side of it."""
    n = len(w)
    on = np.flatnonzero(w[i] == w[i + p])
    p, i = p[on].astype(np.int64), i[on].astype(np.int64)
    half = np.maximum(least - p, p) // 2
    right, left = np.ones(len(p), bool), np.ones(len(p), bool)
    for step in (1, 2, 3, 6, n):
        if not len(p):
            break
        o = np.minimum(step, half)
        ahead, back = i + o, i - o
        right &= (ahead + p < n) & (w[np.minimum(ahead, n - 1)] == w[np.minimum(ahead + p, n - 1)])
        left &= (back >= 0) & (w[np.maximum(back, 0)] == w[np.maximum(back + p, 0)])
        keep = right | left
        p, i, half, right, left = (x[keep] for x in (p, i, half, right, left))
    return p, i


def _extend(w: np.ndarray, p: int, i: int) -> tuple[int, int]:
    """The stretch of places around i, end exclusive, at which the word p on is equal."""
    n, end, size = len(w), i + 1, CHUNK
    while end + p < n:
        a = w[end : min(end + size, n - p)]
        same = a == w[end + p : end + p + len(a)]
        if not same.all():
            end += int(same.argmin())
            break
        end, size = end + len(a), 2 * size
    begin, size = i, CHUNK
    while begin > 0:
        lo = max(0, begin - size)
        same = w[lo:begin] == w[lo + p : begin + p]
        if not same.all():
            begin -= int(same[::-1].argmin())
            break
        begin, size = lo, 2 * size
    return begin, end


def _stretches(w: np.ndarray, p: int, points: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of period p that hold one of the sorted points."""
    if len(points) * CHUNK > len(w):
        same = np.zeros(len(w) - p + 2, np.int8)
        same[1:-1] = w[:-p] == w[p:]
        edge = np.diff(same)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.unique(np.searchsorted(begins, points, side="right") - 1)
        yield from zip(begins[at].tolist(), ends[at].tolist(), strict=True)
        return
    k = 0
    while k < len(points):
        begin, end = _extend(w, p, int(points[k]))
        yield begin, end
        k = int(np.searchsorted(points, end))


def runs_of(w: np.ndarray, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start and period."""
    n = len(w)
    if n < max(least, 2):
        return []
    found: list[tuple[int, int, int]] = []
    spans: set[tuple[int, int]] = set()
    for grid in _grid(n):
        ps, points = _survivors(w, *grid, least)
        if not len(ps):
            continue
        edge = np.flatnonzero(np.concatenate([[True], ps[1:] != ps[:-1]]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ps)], strict=True):
            p, at = int(ps[a]), points[a:b]
            for s, e, q in found:
                if p % q == 0 and e - s > p:
                    at = at[(at < s) | (at + p >= e)]
            for begin, end in _stretches(w, p, at):
                if end - begin >= max(least - p, p) and (begin, end + p) not in spans:
                    found.append((begin, end + p, p))
                    spans.add((begin, end + p))
    return sorted((s, e - s, q) for s, e, q in found)


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's planted repetition: for every tenth id, by hash, the word numbers that the words of its text become."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def _joined(w: K.Words, chosen: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The chosen words (numbers in the block) of each row, joined by one space."""
    size = (w.e - w.s + 1)[chosen]
    gap = np.ones(len(chosen), np.int64)
    gap[np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))[: len(chosen)]] = 0
    to = np.cumsum(size + gap)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out[np.repeat(to - size - before, size) + step] = w.low[np.repeat(w.s[chosen] - before, size) + step]
    last = np.searchsorted(row, np.arange(rows), side="right")
    ends = np.concatenate([[0], to])[last]
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(out.tobytes())).cast(pa.string())


def _scan_block(ids: list, data: np.ndarray, off: np.ndarray, least: int, order: Callable | None) -> tuple[np.ndarray, list, pa.Array]:
    w = K.Words(data, off, K.space_table())
    number = w.strings().dictionary_encode().indices.to_numpy() if len(w.s) else np.empty(0, np.int32)
    source, keep = np.arange(len(w.s)), np.ones(len(w.s), bool)
    runs: list[list[tuple[int, int, int]]] = []
    for r, (a, b) in enumerate(zip(w.edge[:-1].tolist(), w.edge[1:].tolist(), strict=True)):
        moved = order(ids[r], b - a) if order else None
        if moved is not None:
            source[a:b] = a + moved
        mine = runs_of(number[source[a:b]], least)
        for s, n, p in mine:
            keep[a + s + p : a + s + n] = False
        runs.append(mine)
    row = np.repeat(np.arange(len(off) - 1), np.diff(w.edge))
    return np.diff(w.edge), runs, _joined(w, source[keep], row[keep], len(off) - 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start and period, and its words less those repeated in a run, joined by spaces.

    A word is left out if a run holds it after the run's first period. ``order`` may rearrange the words of a text before it is
    scanned: it gets the id and the number of words, and returns the number of the word to stand at each place, or None.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, data, off in K.blocks(b.column(1)):
                ids = b.column(0).slice(first, len(off) - 1)
                n, runs, text = _scan_block(ids.to_pylist() if order else [], data, off, least, order)
                flat = np.array([x for mine in runs for x in mine], np.int64).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=RUN.names)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), lists, text], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The findings as numbers and digests: n_runs, the longest run (ties: smallest start, then period), all runs and the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    d = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return d.select(
        id_col, "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"),
    )


def duckdb_sql() -> str:
    """The contract's result in SQL: all pairs of equal words of a text, gathered into stretches of equal distance."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc} AS h FROM documents),
s AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
x AS (SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS w FROM s, unnest(range(0, n)) AS r(i)),
pr AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM x JOIN x y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i),
st AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM pr),
long AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS n FROM st GROUP BY doc_id, p, k HAVING count(*) + p >= greatest({MIN_LENGTH}, 2 * p)),
run AS (SELECT doc_id, s, n, min(p) AS p FROM long GROUP BY doc_id, s, n),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS lines, max({{'n': n, 's': -s, 'p': -p}}) AS best FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(s + p, s + n)) AS r(i)),
kept AS (SELECT x.doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.n AS length, -best.p AS period, 1000 * best.n // -best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM s LEFT JOIN agg USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
