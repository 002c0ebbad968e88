import random
import re

from pyspark.sql import functions as F

from tessera.llm import license_scan as L


def brute_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def texts():
    r = random.Random(6)
    vocab = ["gnu", "General", "public", "license", "Apache", "cc", "BY", "mit", "é", "\u212a", "MİT", "9", "b\u212a"]
    out = ["".join(r.choice(vocab) + r.choice([" ", "-", "\n", ", ", ""]) for _ in range(r.choice([0, 1, 2, 30, 200]))) for _ in range(100)]
    return [*out, None, "", "...", "CC BY " * 4000, "Licensed under CC BY-NC 4.0.", "GNU General Public License"]


def test_base_matches_brute_force(spark):
    t = texts()
    df = spark.createDataFrame([*enumerate(t), (5, t[5]), (6, "cc by")], "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("id", F.lit(2))
    rows = L.scan(spark, df).collect()
    want = sorted([(i, *brute_base(x)) for i, x in [*enumerate(t), (5, t[5]), (6, "cc by")]], key=str)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows], key=str) == want
    assert L.scan(spark, df.limit(0)).count() == 0


def test_other_letters_do_not_fold(spark):
    df = spark.createDataFrame([(1, "wor\u212a this work is cc b\u0079"), (2, "M\u0130T license"), (None, "MIT license"), (None, "cc by")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.labels) for r in L.scan(spark, df).collect()) == [("1", "cc-by"), ("2", ""), ("None", "cc-by"), ("None", "mit")]


def test_passages_survive_an_edit_at_every_place(spark):
    docs, want = [], {}
    for text, label in L.PASSAGES:
        w = text.split()
        for i in range(len(w)):
            for e in ([*w[:i], "other", *w[i + 1 :]], [*w[:i], "EXTRA", *w[i:]], [*w[:i], *w[i + 1 :]]):
                want[len(docs)] = label
                docs.append((len(docs), "some words before " + " ".join(e) + ", and after"))
    got = {r.doc_id: r for r in L.scan(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    lost = [docs[i][1] for i, label in want.items() if label not in got[i].labels.split(",") or not L.COVER <= got[i].score <= 1]
    assert not lost


def test_passages(spark):
    p = {}
    for text, label in L.PASSAGES:
        p.setdefault(label, text)
    w = p["bsd"].split()
    docs = [(1, f"head. {p['isc']} tail"), (3, " ".join(w[:7])), (4, " ".join(random.Random(1).sample(w, len(w)))), (5, p["gpl"]), (6, " ".join(w[:10]) + " x y z " * 60 + " ".join(w[10:]))]
    got = {r.doc_id: r for r in L.scan(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].labels == "isc" and got[1].score == 1.0 and got[1].base_labels == ""
    assert got[3].labels == "" and got[3].score == 0.0 and got[4].labels == ""
    assert got[5].labels == "gpl" and got[5].n_base == 1 and got[6].labels == ""


def test_sql_agrees_where_passages_are(spark, tmp_path):
    """The fixture tables hold base phrases only; here are edited passages, and diagonals to merge."""
    import duckdb

    r = random.Random(12)
    docs = [(i, t) for i, t in enumerate(texts())]
    for text, _ in L.PASSAGES:
        for n in (0, 1, 2, 4, 8):
            w = text.split()
            for _ in range(n):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[], ["new"], [w[i], "more"], ["one", "two"]])
            docs.append((len(docs), " ".join(["Intro", *w, "and", *text.split()[: r.randint(0, 9)]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    from tests.sqlcompare import assert_same

    got = L.scan(spark, df)
    assert_same(got, con, L.duckdb_sql())
    assert got.where("labels <> base_labels AND score < 1").count() > 20
