import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tessera.llm import resample as R


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def features(t):
    w = words(t)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(docs, bench):
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)) for rows in (docs, bench))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        f = features(x)
        g = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in map(bucket, f)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def fixture():
    r = random.Random(9)
    vocab = ["the", "Of", "zé", "9x", "straße", "一二", "q", *(f"w{i}" for i in range(200))]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 2, 19, 20, 60, 200]))) for i in range(120)]
    docs += [(300, None), (301, ""), (302, "--"), (303, "the " * 4000), (5, docs[5][1]), (5, "other text " * 15), (None, text(30)), (None, None)]
    return docs, [(i, text(40)) for i in range(5)] + [(7, None), (8, "")]


def test_matches_brute_force(spark):
    docs, bench = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rank", "2 as score", "'x' as feature", "3 as id", "4 as n_words").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "'x' as feature", "1 as n")
    got = R.resample(df, b)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, bench)


def test_without_rows(spark):
    docs, bench = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert R.resample(d.limit(0), b).count() == 0
    assert sorted(map(tuple, R.resample(d, b.limit(0)).collect()), key=str) == brute(docs, [])


def test_dictionary_holds_each_string_once(spark):
    docs, bench = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(bench, "item_id long, text string")
    raw, target = (Counter(f for _, x in rows for f in features(x)) for rows in (docs, bench))
    got = R.dictionary(d, b).collect()
    assert R.dictionary(d, b)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert sorted(map(tuple, got)) == sorted((f, raw[f], target[f], bucket(f)) for f in raw.keys() | target.keys())


def test_longer_runs_and_small_blocks(spark):
    docs, _ = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").select("text").repartition(2)
    want = Counter(" ".join(w[i : i + k]) for _, x in docs for w in [words(x)] for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    got = Counter()
    for r in R.packed_counts(d, longest=4, block=300).collect():
        assert len(r.features.split("\n")) == len(r.counts)
        for f, n in zip(r.features.split("\n"), r.counts, strict=True):
            got[f] += n
    assert got == want


def test_sql_with_repeated_and_null_rows(spark):
    import duckdb

    from tests.sqlcompare import assert_same

    docs, bench = fixture()
    con = duckdb.connect()
    for name, rows, ddl in (("documents", docs, "doc_id BIGINT"), ("benchmark", bench, "item_id BIGINT")):
        con.execute(f"CREATE TABLE {name} ({ddl}, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert_same(R.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")), con, R.duckdb_sql())
