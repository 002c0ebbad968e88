"""Operator 10: quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose share exceeds a cutoff: symbols per word character, capitals per
word character, repeated lines, words in repeated five-word windows; shares are whole thousandths.
Cutoffs are chosen for each stratum of word counts from labelled documents of quality 1 (a holdout
of the labels, by a hash of the id): a cutoff is admissible if an exact binomial test refutes, at
level delta / (rules * strata), that it falsely rejects more than limit / rules of the stratum's
good documents. The cutoffs of a rule are nested, so testing them from the mildest on needs no further
correction, and all admissible ones hold together with confidence 1 - delta. Among them the one
with the best balance of bad rows caught against good rows lost is taken, the mildest on ties; a rule
that catches nothing, or that too few labels can certify, is not used in that stratum.

Scale: one narrow pass over the texts for the statistics, a shuffle of a few integers for each
labelled document, and histograms of at most 1,001 bins for each rule and stratum, whatever the
input; the driver receives one row for each rule and stratum.

Defined results: a null text has no words and fails the base rule; repeated rows are judged alike; a
document with several label rows counts once for each; labels without a document, and null labels,
are ignored; columns may have any names; without labels only the base rule decides; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by contract: white space, symbols, window length and the base rule.
SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Strata by number of words: below each bound, and the rest.
STRATA = (60, 300)
RULES = ("symbols", "capitals", "dup_lines", "repeats")
#: Share of the good documents of a stratum that all rules together may reject, and the risk of exceeding it.
LIMIT, DELTA = 0.05, 0.05
#: Bad documents caught weigh one, good documents lost this much.
WEIGHT = 5


def statistics(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, q_n_words, ...): the columns to carry (by default all) as one struct, so that their names cannot clash, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (long) under a prefix ``q_``."""
    row = F.struct(*[df[c] for c in (carry or df.columns)])
    df = df.select(row.alias("row"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("q_text"))
    text = F.col("q_text")
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    d = df.withColumns({"q_w": words, "q_l": lines, "q_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"), "q_n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")})
    d = d.withColumns(
        {
            "q_n_words": F.size("q_w").cast("long"),
            "q_word_chars": F.length(F.array_join("q_w", "")).cast("long"),
            "q_n_lines": F.size("q_l").cast("long"),
            "q_n_dup_lines": (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long"),
            "q_h": F.transform("q_w", lambda w: F.xxhash64(w)),
        }
    ).drop("q_w", "q_l", "q_text")
    gram = F.transform(F.sequence(F.lit(0), F.size("q_h") - WINDOW), lambda i: F.xxhash64(*[F.get("q_h", i + k) for k in range(WINDOW)]))
    d = d.withColumn("q_g", F.when(F.size("q_h") >= WINDOW, gram)).drop("q_h")
    # places of windows that stand twice, from a sort that brings equal hashes together
    d = d.withColumn("q_s", F.when(F.size(F.array_distinct("q_g")) < F.size("q_g"), F.sort_array(F.transform("q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("q_g")
    twice = F.filter("q_s", lambda p, j: (p.h == F.get("q_s", j - 1).h) | (p.h == F.get("q_s", j + 1).h))
    d = d.withColumn("q_p", F.when(F.col("q_s").isNotNull() & (F.size("q_s") > 0), F.sort_array(F.transform(twice, lambda p: p.i)))).drop("q_s")
    reach = F.aggregate("q_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW), i + WINDOW - a.end)).cast("long").alias("n"), (i + WINDOW).alias("end")), lambda a: a.n)
    return d.withColumn("q_n_repeat_words", F.when(F.col("q_p").isNotNull() & (F.size("q_p") > 0), reach).otherwise(F.lit(0).cast("long"))).drop("q_p")


def _share(part: str, whole: str) -> Column:
    return F.floor(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))) * 1000).cast("int")


def _shares() -> dict[str, Column]:
    return {
        "symbols": _share("q_n_symbols", "q_word_chars"),
        "capitals": _share("q_n_capitals", "q_word_chars"),
        "dup_lines": _share("q_n_dup_lines", "q_n_lines"),
        "repeats": _share("q_n_repeat_words", "q_n_words"),
    }


def _stratum() -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(F.col("q_n_words") < STRATA[k], k).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))


def _most_false(n: Column, limit: float, level: float) -> Column:
    """The largest k for which P(Binomial(n, limit) <= k) <= level; -1 if there is none."""
    import math

    odds, zero = math.log(limit / (1 - limit)), math.log1p(-limit)
    start = F.struct((n * zero).alias("t"), F.exp(n * zero).alias("cdf"), F.when(F.exp(n * zero) <= level, 0).otherwise(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        t = a.t + F.log((n - i + 1) / i) + odds
        cdf = a.cdf + F.exp(t)
        return F.struct(t.alias("t"), cdf.alias("cdf"), F.when(cdf <= level, i.cast("long")).otherwise(a.k).alias("k"))

    top = F.floor(n * limit).cast("long")
    return F.aggregate(F.when(top >= 1, F.sequence(F.lit(1).cast("long"), top)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a.k)


def fit_cutoffs(stats: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA, id_col: str = "doc_id", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, n_good, lost, caught): the chosen cutoffs; a rule without one is absent."""
    held = labels.select(labels[label_id].alias("q_id"), labels[label_col].cast("int").alias("q_y")).where("q_y in (0, 1)").where(F.pmod(F.crc32(F.col("q_id").cast("string").cast("binary")), F.lit(4)) != 2)
    rows = stats.where(~base_failed()).select(F.col("row")[id_col].alias("q_id"), _stratum().alias("stratum"), *[c.alias(r) for r, c in _shares().items()])
    seen = rows.join(held, "q_id")
    good, bad = F.col("q_y") == 1, F.col("q_y") == 0
    size = seen.groupBy("stratum").agg(F.count(F.when(good, 1)).alias("n_good"))
    long = seen.select("stratum", "q_y", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "bin"))
    hist = long.groupBy("stratum", "rule", "bin").agg(F.count(F.when(good, 1)).alias("g"), F.count(F.when(bad, 1)).alias("b"))
    # a cutoff c rejects bins above c; candidates are the bins below an occupied one
    from pyspark.sql import Window

    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    cand = hist.select("stratum", "rule", (F.col("bin") - 1).alias("cutoff"), F.sum("g").over(above).alias("lost"), F.sum("b").over(above).alias("caught")).where("cutoff >= 0")
    k = size.select("stratum", "n_good", _most_false(F.col("n_good"), limit / len(RULES), delta / (len(RULES) * (len(STRATA) + 1))).alias("k"))
    ok = cand.join(k, "stratum").where("lost <= k").withColumn("gain", F.col("caught") - WEIGHT * F.col("lost")).where("gain > 0")
    best = ok.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff", "n_good", "lost", "caught")).alias("x"))
    return best.select("stratum", "rule", "x.cutoff", "x.n_good", "x.lost", "x.caught")


def rejected_by(cutoffs: list) -> Column:
    """Whether a row's statistics exceed a cutoff of its stratum."""
    shares = _shares()
    out = F.lit(False)
    for r in cutoffs:
        out = out | ((_stratum() == r["stratum"]) & (shares[r["rule"]] > r["cutoff"]))
    return out


def judge(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """stats with q_base_failed and q_kept, never null. At most one cutoff for each rule and stratum comes to the driver."""
    rules = cutoffs.collect()
    return stats.withColumns({"q_base_failed": base_failed(), "q_kept": ~base_failed() & ~rejected_by(rules)})


def verdicts(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(
        F.col("row")[id_col].alias(id_col), F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_n_symbols").alias("n_symbols"), F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
    )
