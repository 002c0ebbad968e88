import random
import re

from tessera.llm.components import connected_components
from tessera.llm.near_dup import drop_duplicates, near_duplicates
from tessera.llm.workspace import Workspace


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})


def brute(docs, k):
    s = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs))


def fixture():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(300)] + ["The", "of", "é", "\x00"]
    docs, n = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 6, 40, 120, 300]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0, 0.01, 0.04, 0.07, 0.2]))):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((n, r.choice([" ", "\n", " \t"]).join(w)))
            n += 1
    # a chain: each next to its neighbour only
    w = [f"c{i}" for i in range(60)]
    for i in range(12):
        docs.append((n, " ".join(w)))
        w = w[4:] + [f"d{i}_{j}" for j in range(4)]
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "a " * 5000), (n + 4, "A " * 4000), (n + 5, docs[0][1])]
    r.shuffle(docs)
    return docs


def test_components_match_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "'z' as component_id")
    for k in (2, 5):
        assert sorted(map(tuple, near_duplicates(spark, df, size=k).collect())) == brute(docs, k)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (2, "A  b c")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(spark, df, size=2).collect())) == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)]
    assert near_duplicates(spark, df.limit(0), size=2).count() == 0
    assert drop_duplicates(spark, df.limit(0)).count() == 0


def test_one_id_with_two_texts_and_null_ids(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(2, long("p")), (3, long("p") + " end"), (5, long("p") + " stop"), (5, long("q")), (6, long("q")), (None, long("q") + " x"), (None, long("r")), (None, long("r") + " y"), (None, None), (None, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _gone", "2 as v", "3 as k1", "4 as word")
    got = [tuple(r) for r in near_duplicates(spark, df, size=2).collect()]
    some = lambda i: sorted((r[1:] for r in got if r[0] == i), key=str)
    assert some(2) == [(29, 2, True)] and some(3) == [(30, 2, False)] and some(6) == [(29, 5, False)] and some(8) == [(0, 8, True)]
    assert some(5) == [(29, 5, True), (30, 2, False)]
    null = [r[1:] for r in got if r[0] is None]
    assert sorted(x for x in null if x[1] is not None) == [(30, 5, False)]
    assert sorted(x[2] for x in null if x[0] > 28 and x[1] is None) == [False, True] and [x[2] for x in null if x[0] == 0] == [True, True]
    left = drop_duplicates(spark, df, size=2)
    assert left.columns == df.columns
    kept = {(r.doc_id, r.text) for r in left.collect()}
    assert (5, long("q")) in kept and (5, long("p") + " stop") not in kept and len(kept) == 6 and left.count() == 6


def test_a_bucket_of_many_unlinked_members(spark):
    """Documents that share most of a text, none of them linked: their buckets are large, and few of their pairs may meet."""
    r = random.Random(5)
    head = " ".join(f"h{i}" for i in range(60))
    docs = [(i, head + " " + " ".join(f"t{r.randrange(10**6)}" for _ in range(30))) for i in range(4000)]
    docs += [(4000 + i, docs[i][1] + " z") for i in range(0, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = near_duplicates(spark, df, size=2).collect()
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id != x.component_id) == [(4000 + i, i) for i in range(40)]


def test_star_contraction_on_paths_and_hubs(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(80)] + [(500, 500)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"))
    assert sorted(map(tuple, got.collect())) == sorted((x, root(x)) for x in up)


def test_structured_long_words_are_told_apart(spark):
    from tests.llm.test_textkit import twins

    docs = [(2 * i + j, w + " x y z") for i, size in enumerate((512, 1024, 8192)) for j, w in enumerate(twins(size))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_duplicates(spark, df, size=2, percent=80)
    assert sorted(tuple(r)[:4] for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(docs, 2)
