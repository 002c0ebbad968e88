"""Operator 1: line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are linked where their edit distance is at most ``tau`` and at most one edit for every ``per``
characters of the shorter line, so that a line of eight characters may differ in one. A line of n characters is cut into
tau + 1 nearly equal segments; of two linked lines, the longer one holds one segment of the shorter
one unchanged, at a start that both the edits left of it and those right of it allow. So every
line is indexed under its segments (with its length and the segment's number), and probes the index
with its substrings at the allowed starts for the lengths n - tau to n; its own segments are among these.
Candidates also have to agree in their letter counts (each edit moves at most two of them by one), which is tested inside
the join, and are verified by a banded bit-parallel edit distance: the band of 2 * tau + 1 diagonals
is one word of bits that slides along both lines.

Equal lines are one class, named by their first place (document id, line number), so the
copies of a common line are one row of the join. A line is kept if it is the first of its class
and no class that begins earlier is linked with its own.

Scale: copies of a line are summed up on the map side to one row of at most 12 hashes (tau = 2) without
text; lines are shuffled as text once, to meet the candidate pairs. Index buckets are sort-merge
joins of two plain shuffles, which adaptive execution splits where a segment is common.

Defined results: lines without a word character are not lines here (they are never dropped);
null texts have no lines; lines shorter than ``per`` allow no edit, so they are compared exactly. Places are ordered by id and
line number, those of rows without an id last; rows that share an id (or have none) share its places, so equal lines
that stand there under one number are kept or dropped alike; empty tables give empty results. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sieve
from tessera.llm.workspace import Workspace

TAU = 2
#: Characters of the shorter line for each edit.
PER = 8
#: Letters whose counts are compared before verification.
LETTERS = "etanoirsdh"
VISIBLE = r"[^ \t\n\x0B\f\r]"
#: More than any line number.
PLACES = 1 << 31
#: Stands for a null id in the order of places: more than any id.
NO_ID = str(1 << 63)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, r, k, line): document id, hash of its text, line number from 0, and the line, for lines with a visible character."""
    text = docs[text_col].cast("string")
    d = docs.select(docs[id_col].cast("long").alias("d"), F.xxhash64(text).alias("r"), F.posexplode(F.split(text, "\n", -1)).alias("k", "line"))
    return d.where(F.col("line").rlike(VISIBLE))


def _segment(i: int, gap: int, tau: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i (from 1) of a line gap characters shorter, from its columns b<gap> and l<gap>: quotient and rest of the length."""
    m = tau + 1
    base, long = F.col(f"b{gap}"), F.col(f"l{gap}")
    return (i - 1) * base + F.greatest(F.lit(0), long + (i - 1 - m)) + 1, base + (long > m - i).cast("int")


def _cut(start: Column, size: Column, i: int) -> Column:
    """Segment number, start and length of a run in one long, so that equal runs are found by equal numbers."""
    return F.shiftleft(size.cast("long"), 33).bitwiseOR(F.shiftleft(start.cast("long"), 3)).bitwiseOR(F.lit(i).cast("long"))


def _hash_cut(wide: Column, cut: Column) -> Column:
    start = F.shiftrightunsigned(cut, 3).bitwiseAND(F.lit((1 << 30) - 1).cast("long")).cast("int")
    return F.xxhash64(cut.bitwiseAND(F.lit(7).cast("long")), F.substring(wide, 4 * (start - 1) + 1, 4 * F.shiftrightunsigned(cut, 33).cast("int")))


def with_keys(lines: DataFrame, tau: int, per: int) -> DataFrame:
    """lines with ``traits`` and ``a0``, ``a1`` ...: the hashes of a line's distinct substrings that may equal a segment of a line of n - tau to n characters, its own tau + 1 segments first.

    They are null where a line has no more of them or is shorter than ``per``. Hashes are taken from four bytes a
    character, so that a run is found without a scan.
    """
    m = tau + 1
    parts = {f"{c}{gap}": F.expr(f"CAST({'(n - %d) DIV %d' % (gap, m) if c == 'b' else '(n - %d) %% %d' % (gap, m)} AS INT)") for gap in range(m) for c in "bl"}
    own, others = [], []
    for i in range(1, m + 1):
        for gap in range(m):
            start, size = _segment(i, gap, tau)
            low, high = max(-(i - 1), gap - (tau + 1 - i)), min(i - 1, gap + (tau + 1 - i))
            for shift in range(low, high + 1):
                (own if gap == shift == 0 else others).append(_cut(start + shift, size, i))
    near = F.col("n") >= per
    # a run that leaves a very short line has fewer characters than it should: at worst a candidate that is not confirmed
    cuts = F.when(near, F.array_distinct(F.array(*own, *others)))
    d = lines.withColumns({"n": F.length("line"), "w": F.encode("line", "UTF-32")}).withColumns(parts).withColumn("cuts", cuts)
    # one column for each hash, in one step with the fold of the traits, which keeps it out of whole-stage code: there the
    # hashes of 573,078 lines took 7.8 s, outside 2.3 s (four cores; presumably one method too large for the JVM to compile)
    keys = {f"a{j}": F.when(F.get("cuts", F.lit(j)).isNotNull(), _hash_cut(F.col("w"), F.get("cuts", F.lit(j)))) for j in range(n_probes(tau))}
    return d.select(*lines.columns, F.when(near, _traits(F.col("line"), F.col("n"))).alias("traits"), *[c.alias(x) for x, c in keys.items()])


def n_probes(tau: int) -> int:
    m = tau + 1
    return sum(min(i - 1, g + m - i) - max(1 - i, g - (m - i)) + 1 for i in range(1, m + 1) for g in range(m))


def _count(line: Column, letter: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter)))


def _traits(line: Column, n: Column) -> Column:
    """The length modulo 256 and, above it, the letter counts modulo 32, in one long."""
    packed = F.aggregate(F.array(*[_count(line, c) for c in reversed(LETTERS)]), F.lit(0).cast("long"), lambda t, x: F.shiftleft(t, 5).bitwiseOR(x.bitwiseAND(F.lit(31)).cast("long")))
    return F.shiftleft(packed, 8).bitwiseOR(n.bitwiseAND(F.lit(255)).cast("long"))


def _may_be_near(a: str, b: str, ta: str, tb: str, tau: int) -> str:
    """SQL for what edits allow, with each pair in one direction: b is at most tau longer than a, or as long and numbered higher; letter counts differ by at most 2 * tau in sum.

    Residues never differ by more than the true values.
    """
    longer = f"(({tb} & 255L) - ({ta} & 255L)) & 255L"

    def differ(shift: int) -> str:
        d = f"abs((shiftrightunsigned({ta}, {shift}) & 31L) - (shiftrightunsigned({tb}, {shift}) & 31L))"
        return f"least({d}, 32L - {d})"

    return f"({longer}) <= {tau} AND ({a} < {b} OR ({longer}) <> 0L AND {a} <> {b}) AND " + " + ".join(differ(8 + 5 * j) for j in range(len(LETTERS))) + f" <= {2 * tau}"


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most tau; tau + 1 where it is above tau.

    Bit j of the band is pattern row i - tau - 1 + j at text column i. Vertical differences +1 and -1
    are the bit sets vp and vn; the score follows the diagonal to the last row and then runs along it.
    Both strings must be longer than tau.
    """
    width = 2 * tau + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    lit = lambda v: F.lit(v).cast("long")
    p, t = F.split(a, ""), F.split(b, "")

    def with_arrays(s: Column) -> Column:
        rows = F.size(s.p)

        def step(st: Column, i: Column) -> Column:
            c = F.get(s.t, i)
            x = lit(0)
            for j in range(-tau, tau + 1):
                x = x.bitwiseOR(F.when(F.get(s.p, i + j) == c, lit(1 << (width - 1 - tau + j))).otherwise(lit(0)))
            begin = F.struct(x.alias("x"), st.vp.alias("vp"), st.vn.alias("vn"), st.score.alias("score"), st.row.alias("row"))
            return F.get(F.transform(F.array(begin), lambda q: moved(q, i)), 0)

        def moved(q: Column, i: Column) -> Column:
            d0 = ((q.x.bitwiseAND(q.vp) + q.vp).bitwiseXOR(q.vp)).bitwiseOR(q.x).bitwiseOR(q.vn).bitwiseAND(lit(full))
            have = F.struct(d0.alias("d0"), q.vp.alias("vp"), q.vn.alias("vn"), q.score.alias("score"), q.row.alias("row"))
            return F.get(F.transform(F.array(have), lambda h: ended(h, i)), 0)

        def ended(h: Column, i: Column) -> Column:
            hp = h.vn.bitwiseOR(lit(full).bitwiseXOR(h.d0.bitwiseOR(h.vp)))
            hn = h.d0.bitwiseAND(h.vp)
            down = F.shiftrightunsigned(h.d0, 1)
            on_diagonal = i < rows - tau
            score = h.score + F.when(on_diagonal, F.when(h.d0.bitwiseAND(lit(top)) == 0, 1).otherwise(0)).otherwise(
                F.when(hp.bitwiseAND(h.row) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(h.row) != 0, 1).otherwise(0)
            )
            vp = hn.bitwiseOR(lit(full).bitwiseXOR(down.bitwiseOR(hp)))
            vn = down.bitwiseAND(hp)
            row = F.when(on_diagonal, h.row).otherwise(F.shiftrightunsigned(h.row, 1))
            return F.struct(vp.alias("vp"), vn.alias("vn"), score.cast("int").alias("score"), row.alias("row"))

        start = F.struct(lit(((1 << (tau + 1)) - 1) << (width - tau - 1)).alias("vp"), lit(0).alias("vn"), F.lit(tau).alias("score"), lit(top >> 1).alias("row"))
        far = F.lit(2 * tau) + F.abs(F.size(s.t) - rows)
        return F.aggregate(F.sequence(F.lit(0), F.size(s.t) - 1), start, lambda st, i: F.when(st.score > far, st).otherwise(step(st, i)), lambda st: F.least(st.score, F.lit(tau + 1)))

    return F.get(F.transform(F.array(F.struct(p.alias("p"), t.alias("t"))), with_arrays), 0)


def _at(d: Column, k: Column) -> Column:
    """Document and line number packed into one decimal, so that the first place is a minimum of fixed width."""
    return (F.coalesce(d.cast("decimal(38,0)"), F.lit(NO_ID).cast("decimal(38,0)")) * PLACES + k).cast("decimal(38,0)")


def _place(at: str) -> Column:
    """(d, k) of a place that was packed into one decimal."""
    k = F.pmod(F.col(at), F.lit(PLACES).cast("decimal(38,0)"))
    d = ((F.col(at) - k) / PLACES).cast("decimal(38,0)")
    return F.struct(F.when(d < F.lit(NO_ID).cast("decimal(38,0)"), d.cast("long")).alias("d"), k.cast("int").alias("k"))


def line_classes(spark: SparkSession, docs: DataFrame, tau: int = TAU, per: int = PER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, r, k, first, n_links, kept) of every line: first (d, k) is the first place of its class, n_links the number of other classes linked with it."""
    if per <= tau + 1:
        raise ValueError("lines that allow an edit have to be longer than their number of segments")
    if tau > 6:
        raise ValueError("segments are numbered in three bits")
    work = Workspace(spark, "lines")
    lines = lines_of(docs, id_col, text_col)
    named = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")})
    places = work.save(named.select("d", "r", "k", "h1", "h2"), "places")

    # one row for each class, with its first place and its keys; copies of a line meet as fixed-width sums
    keyed = with_keys(named, tau, per)
    asks = [f"a{j}" for j in range(n_probes(tau))]
    keyed = keyed.select("h1", "h2", _at(F.col("d"), F.col("k")).alias("at"), "traits", *asks)
    classes = keyed.groupBy("h1", "h2").agg(*[F.min(c).alias(c) for c in ("at", "traits", *asks)])
    classes = work.save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    pairs = work.save(_candidates(classes, asks, tau), "pairs")

    # the texts of the lines in question, from their first places
    first = classes.select("c", "h1", "h2", "at")
    asked = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    asked = work.save(asked.join(first, "c"), "asked")
    text = work.save(_texts(named, asked), "text")
    both = pairs.join(text.select(F.col("c").alias("a"), F.col("line").alias("la")), "a").join(text.select(F.col("c").alias("b"), F.col("line").alias("lb")), "b")
    longer = F.length("la") >= F.length("lb")
    both = both.select("a", "b", F.when(longer, F.col("la")).otherwise(F.col("lb")).alias("p"), F.when(longer, F.col("lb")).otherwise(F.col("la")).alias("t"))
    near = both.select("a", "b", banded_distance(F.col("p"), F.col("t"), tau).alias("dist"), F.length("t").alias("n")).where(f"dist <= {tau} AND dist * {per} <= n")
    links = work.save(near.select("a", "b"), "links")
    ways = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = classes.select("c", "at")
    ways = ways.join(at.select(F.col("c").alias("a"), F.col("at").alias("fa")), "a").join(at.select(F.col("c").alias("b"), F.col("at").alias("fb")), "b")
    degree = ways.groupBy("a").agg(F.count("*").alias("n_links"), F.max((F.col("fb") < F.col("fa")).cast("int")).alias("later")).withColumnRenamed("a", "c")
    known = first.join(degree, "c", "left").select("h1", "h2", "at", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("later", F.lit(0)).alias("later"))
    known = work.save(known, "known")
    work.drop("classes", "pairs", "asked", "text", "links")
    here = _at(F.col("d"), F.col("k")) == F.col("at")
    return places.join(known, ["h1", "h2"]).select("d", "r", "k", _place("at").alias("first"), "n_links", ((F.col("later") == 0) & here).alias("kept"))


def _candidates(classes: DataFrame, asks: list[str], tau: int) -> DataFrame:
    """Pairs (a, b) of classes of which one asks for a segment of the other and edits may make the one the other."""
    x = classes.select(F.col("c").alias("a"), F.col("traits").alias("ta"), F.explode(F.array(*asks[: tau + 1])).alias("key")).where("key IS NOT NULL")
    y = classes.select(F.col("c").alias("b"), F.col("traits").alias("tb"), F.explode(F.array(*asks)).alias("key")).where("key IS NOT NULL")
    pairs = x.join(y, "key").where(F.expr(_may_be_near("a", "b", "ta", "tb", tau)))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts(named: DataFrame, asked: DataFrame) -> DataFrame:
    """(c, line) of the classes asked for, from their first places."""
    maybe, _ = sieve.split(named, F.col("h1"), asked, F.col("h1"))
    return maybe.withColumn("at", _at(F.col("d"), F.col("k"))).join(asked, ["at", "h1", "h2"]).select("c", "line").dropDuplicates(["c"])


def drop_lines(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that are not kept taken out of their texts; a document that loses every visible line goes."""
    work = Workspace(docs.sparkSession, "gone")
    gone = classes.groupBy("d", "r").agg(F.collect_set(F.when(~F.col("kept"), F.col("k"))).alias("gone"), F.count(F.when(F.col("kept"), 1)).alias("left")).where("size(gone) > 0")
    gone = work.save(gone, "lines")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    d = docs.select(whole, docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    d = d.select("row", "id", "text", F.xxhash64("text").alias("h"))
    maybe, other = sieve.split(d, F.xxhash64("id", "h"), gone, F.xxhash64("d", "r"))
    j = maybe.join(gone, F.col("id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("r")), "left").where("left IS NULL OR left > 0")
    kept = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(kept.cast(docs.schema[text_col].dataType))
    names = docs.columns
    return j.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]).union(other.select(*[F.col("row")[c].alias(c) for c in names]))
