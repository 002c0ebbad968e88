import random
import re
from math import exp, lgamma, log

from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {p for v in grams.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), n < 10 or 100 * len(rep) > 20 * n


def texts():
    r = random.Random(4)
    vocab = ["a", "b", "cé", "#x", "<>", "Über", "🙂|", "\x00", " "]
    out = ["".join(r.choice(vocab) + r.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b"]) for _ in range(r.choice([0, 3, 5, 12, 60]))) for _ in range(120)]
    return [*out, None, "", " \n\n ", "x " * 20000, "a b c d e a b c d e", "one\none\n \n \none ", " lead", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"]


def test_statistics_match_brute_force(spark):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").selectExpr("*", "'clash' as n_words", "'clash' as q_n_words", "1 as row", "2 as q_w")
    none = spark.createDataFrame([], "stratum int, rule string, cutoff int")
    got = {r[0]: tuple(r[1:7]) for r in Q.verdicts(Q.judge(Q.statistics(df), none)).collect()}
    for i, x in enumerate(t):
        assert got[i] == brute(x), repr(x)[:80]


def test_binomial_bound(spark):
    def most(n, p, level):
        cdf, k = 0.0, -1
        for i in range(n + 1):
            cdf += exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))
            if cdf <= level:
                k = i
        return k

    df = spark.createDataFrame([(n,) for n in (0, 1, 50, 300, 900, 2000)], "n long")
    got = df.select("n", Q._most_false(F.col("n"), 0.02, 0.01).alias("k")).collect()
    assert {r.n: r.k for r in got} == {n: most(n, 0.02, 0.01) for n in (0, 1, 50, 300, 900, 2000)}


def test_cutoffs_catch_bad_and_keep_good(spark):
    r = random.Random(8)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    docs = [(i, good()) for i in range(1500)] + [(i, good().replace(" ", "### ")) for i in range(1500, 1700)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(1700)] + [(9999, 1), (None, 1), (3, None)], "doc_id long, quality int")
    stats = Q.statistics(df)
    out = {x.doc_id: x.kept for x in Q.verdicts(Q.judge(stats, Q.fit_cutoffs(stats, labels))).collect()}
    assert sum(out[i] for i in range(1500)) >= 1499 and not any(out[i] for i in range(1500, 1700))
    judged = Q.judge(stats, Q.fit_cutoffs(stats, labels))
    assert judged.select("row.*").columns == df.columns
    # too few labels certify nothing
    assert Q.fit_cutoffs(stats, labels.where("doc_id % 20 = 0")).count() == 0
    assert Q.fit_cutoffs(stats, labels.limit(0)).count() == 0
    assert Q.verdicts(Q.judge(Q.statistics(df.limit(0)), Q.fit_cutoffs(stats, labels))).count() == 0
