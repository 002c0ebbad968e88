import hashlib
import random
import re

from tessera.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench, n=10):
    wins = set()
    for i, t in bench:
        w = words(t)
        if w:
            k = min(n, len(w))
            wins |= {(tuple(w[a : a + k]), None if i is None else str(i)) for a in range(len(w) - k + 1)}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for win, i in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    items.add(i)
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items - {None})).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def fixture():
    r = random.Random(3)
    vocab = ["the", "of", "Ab", "zé", "9x", "straße", "一二", "b", "c", "qq"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    bench = [(i, text(r.choice([1, 3, 9, 10, 12, 30]))) for i in range(12)] + [(50, None), (51, " ,"), (3, "the the the")]
    bench += [(bench[0][0], bench[0][1])]
    docs = [(i, text(r.randint(0, 60)) + (bench[i % 12][1] if i % 3 == 0 else "") + text(r.randint(0, 20))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "the " * 3000), (0, "repeated the"), (0, "repeated the")]
    return docs, bench


def test_matches_brute_force(spark):
    docs, bench = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as n_words")
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "2 as doc_id")
    got = D.digest(D.find_leaks(d, b))
    assert sorted(map(tuple, got.collect())) == brute(docs, bench)


def test_every_row_has_its_own_result(spark):
    docs, bench = fixture()
    docs += [(9, "clean words"), (None, "no id"), (None, bench[4][1]), (102, None), (None, None)]
    bench += [(4, "another row of item four " + docs[7][1]), (4, bench[4][1] + " and more words that follow"), (None, docs[8][1]), (None, "no id"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as k1", "2 as word", "3 as token", "4 as id")
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "'x' as item", "1 as words")
    want = sorted(brute([(-1 if i is None else i, t) for i, t in docs], bench))
    got = D.digest(D.find_leaks(d, b)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert any(r[3] > 1 for r in want)


def test_spans_are_the_hit_ranges(spark):
    item = " ".join(f"w{i}" for i in range(25))
    text = "a b " + " ".join(f"w{i}" for i in range(12)) + " c " + " ".join(f"w{i}" for i in range(5, 25)) + " w1"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([("q", item), ("r", "c w5")], "item_id string, text string")
    r = D.find_leaks(d, b).first()
    assert [tuple(x) for x in r.spans] == [(2, 35)] and r["items"] == ["q", "r"]


def test_frequent_words_and_long_texts(spark):
    """A window whose shingles are frequent, an item of one frequent word, and a text of a million words."""
    docs = [(i, "the end of the day " * 40) for i in range(50)] + [(99, "the " * 1_000_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(1, "the end of the day the end of the day"), (2, "the")], "item_id long, text string")
    got = {r.doc_id: r for r in D.digest(D.find_leaks(d, b)).collect()}
    assert got[99].n_hit == 1_000_000 and got[99].n_items == 1
    assert got[7].n_hit == got[7].n_words == 200 and got[7].n_items == 2


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.digest(D.find_leaks(d.limit(0), b)).count() == 0
    r = D.digest(D.find_leaks(d, b.limit(0))).first()
    assert (r.n_words, r.n_hit, r.contaminated, r.items_sha256) == (2, 0, False, hashlib.sha256(b"").hexdigest())


def test_clean_rows_stay_whole(spark):
    docs, bench = fixture()
    docs += [(9, "clean words"), (None, "no id"), (None, bench[4][1]), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("'x' as item_id", "*", "1 as _word", "2 as k1")
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(-1 if i is None else i, t) for i, t in docs]
    want = sorted(r[0] for r in brute(rows, bench) if not r[5])
    out = D.drop_contaminated(d, b)
    assert out.columns == d.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want
    assert D.drop_contaminated(d, b.limit(0)).count() == len(docs) and D.drop_contaminated(d.limit(0), b).count() == 0


def test_items_without_an_id(spark):
    """They hit words and count as one item, as in the SQL."""
    import duckdb

    from tessera.llm import catalog
    from tests.sqlcompare import assert_same

    docs = [(1, "x y z"), (2, "q x Y z q"), (3, "a b"), (4, "x y z a b")]
    bench = [(None, "x y z"), (None, "a b"), (7, "a b"), (None, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in D.digest(D.find_leaks(d, b)).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, True), 3: (2, 2, True), 4: (5, 2, True)}
    con = duckdb.connect()
    for name, rows, ddl in (("documents", docs, "doc_id BIGINT"), ("benchmark", bench, "item_id BIGINT")):
        con.execute(f"CREATE TABLE {name} ({ddl}, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert_same(D.digest(D.find_leaks(d, b)), con, catalog.ORACLE_SQL["op2_decontamination"])


def test_structured_long_words_are_told_apart(spark):
    from tests.llm.test_textkit import twins

    for size in (512, 2048):
        a, b = twins(size)
        d = spark.createDataFrame([(1, a + " x y z"), (2, b + " x y z")], "doc_id long, text string")
        got = {r.doc_id: r.n_hit for r in D.digest(D.find_leaks(d, spark.createDataFrame([(1, a)], "item_id long, text string"))).collect()}
        assert got == {1: 1, 2: 0}
