import random

from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def edit(r, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = r.randrange(len(s)), r.randrange(3)
        if kind == 0:
            s[i] = r.choice("abcé")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, r.choice("abcé"))
    return "".join(s)


def test_banded_distance(spark):
    r = random.Random(3)
    rows = []
    for _ in range(600):
        a = "".join(r.choice("abé🙂"[: r.choice([2, 4])]) for _ in range(r.randint(8, 40)))
        b = edit(r, a, r.randint(0, 6))
        if len(b) > 5:
            rows.append((a, b))
    for tau in (1, 2, 3):
        use = [(a, b) if len(a) >= len(b) else (b, a) for a, b in rows if abs(len(a) - len(b)) <= tau]
        got = spark.createDataFrame(use, "a string, b string").select("a", "b", L.banded_distance(F.col("a"), F.col("b"), tau).alias("x")).collect()
        assert all(g.x == min(distance(g.a, g.b), tau + 1) for g in got)


def linked(x, y, tau=2, per=8):
    n = min(tau, min(len(x), len(y)) // per)
    return n > 0 and abs(len(x) - len(y)) <= n and distance(x, y) <= n


def brute(docs, tau, per):
    occ = [(d, k, x) for d, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\f\r")]
    first = {}
    for d, k, x in sorted(occ, key=lambda o: o[:2]):
        first.setdefault(x, (d, k))
    near = {x: [y for y in first if y != x and linked(x, y, tau, per)] for x in first}
    return sorted((d, k, *first[x], len(near[x]), (d, k) == first[x] and all(first[y] > first[x] for y in near[x])) for d, k, x in occ)


def fixture():
    r = random.Random(9)
    base = ["".join(r.choice("abcdeé ") for _ in range(r.choice([3, 7, 8, 9, 15, 16, 17, 18, 19, 20, 33, 60]))) for _ in range(18)]
    docs = []
    for i in range(60):
        lines = [edit(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 2, 3, 4])) for _ in range(r.randint(1, 6))]
        docs.append((i, "\n".join(lines + ["", "  "][: r.randint(0, 2)])))
    return docs + [(100, None), (101, ""), (102, "x" * 700), (103, "x" * 701 + "\n" + "common line of many documents")]


def test_classes_match_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as line", "2 as key", "3 as c")
    for tau in (1, 2, 3):
        got = L.line_classes(spark, df, tau=tau).select("d", "k", "first.d", "first.k", "n_links", "kept").collect()
        assert sorted(map(tuple, got)) == brute(docs, tau, L.PER)


def test_a_line_asks_for_its_own_segments_first(spark):
    r = random.Random(5)
    bases = ["".join(r.choice("abcdeé🙂 ") for _ in range(r.randint(8, 60))) for _ in range(80)]
    for tau in (1, 2, 3):
        rows = [(i, x, edit(r, x, r.randint(0, tau))) for i, x in enumerate(bases)] + [(80, "seven c", "seven x")]
        lines = spark.createDataFrame(rows, "i int, p string, q string").selectExpr("i", "stack(2, p, q) AS line")
        keyed = L.with_keys(lines, tau, L.PER)
        n = L.n_probes(tau)
        assert keyed.columns == ["i", "line", "traits", *[f"a{j}" for j in range(n)]]  # one column for each probe, none for segments
        got = {}
        for x in keyed.collect():
            asks = [a for a in x[3:] if a is not None]
            assert (len(asks) > tau) == (len(x.line) >= L.PER) == (x.traits is not None)
            got.setdefault(x.i, []).append((len(x.line), set(asks[: tau + 1]), set(asks)))
        for short, long in [sorted(v, key=lambda s: s[0]) for v in got.values()]:
            assert short[0] < L.PER or short[1] & long[2]


def test_hashes_are_compiled_in_small_methods(spark):
    lines = spark.createDataFrame([("a line",)], "line string")
    plan = L.with_keys(lines, 2, L.PER)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.split("\n") if "AS a11#" in x] and not [x for x in plan.split("\n") if "AS a11#" in x and "*(" in x.split("Project")[0]]


def test_dropping(spark):
    docs = [(1, "the first line of all\nsecond line, rather long"), (2, "the first line of all!\nanother line entirely\n\nend"), (3, "the first line of all"), (4, None), (5, ""), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit("extra"))
    out = L.drop_lines(df, L.line_classes(spark, df))
    assert out.columns == df.columns
    assert sorted(out.select("doc_id", "text").collect(), key=lambda x: x[0]) == [(1, docs[0][1]), (2, "another line entirely\n\nend"), (4, None), (5, ""), (5, "")]
    assert L.line_classes(spark, df.limit(0)).count() == 0 and L.drop_lines(df.limit(0), L.line_classes(spark, df)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a line that is repeated"), (7, "a line that is repeated"), (8, "a line that is repeated")], "doc_id long, text string")
    c = L.line_classes(spark, df)
    assert sorted((x.d, x.kept) for x in c.collect()) == [(7, True), (7, True), (8, False)]
    assert [x.doc_id for x in L.drop_lines(df, c).collect()] == [7, 7]


def test_rows_without_an_id_come_last(spark):
    docs = [(None, "a line that stands elsewhere too\nonly the nameless have this"), (5, "a line that stands elsewhere too!\nand one more of five"), (None, "a line that stands elsewhere too"), (None, None), (3, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _word", "2 as d", "3 as r", "4 as gone", "5 as left", "6 as id", "7 as h")
    c = L.line_classes(spark, df)
    assert sorted((str(x.d), x.k, str(x.first.d), x.kept) for x in c.collect()) == [("3", 0, "3", True), ("5", 0, "5", True), ("5", 1, "5", True), ("None", 0, "None", False), ("None", 0, "None", False), ("None", 1, "None", True)]
    out = L.drop_lines(df, c)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == sorted([(None, "only the nameless have this"), (5, docs[1][1]), (None, None), (3, "x")], key=str)
