import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic as P


def brute_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    order = P.planted_order(doc_id, len(w))
    w = w if order is None else [w[k] for k in order]
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def fixture():
    r = random.Random(8)
    texts = []
    for k in range(120):
        letters = ["a", "B", "é", "d\x00", "e" * 9, "一"][: r.choice([1, 2, 3, 6])]
        texts.append(r.choice([" ", "\n", " \t"]).join(r.choice(letters) for _ in range(r.choice([0, 1, 11, 12, 13, 40, 150]))))
        base = [r.choice("abcdefgh") for _ in range(r.choice([1, 2, 5, 9, 30]))]
        texts.append(" ".join([*"xyz"[: k % 4], *(base * 6)[: r.randint(2, 150)], *"uvw"[: k % 3], *(base * 3)[1:]]))
    return [*enumerate(texts), (1000, None), (1001, ""), (1002, " \n\x0b"), (5, texts[5]), (5, "another text"), (1003, "same " * 5000), (1004, "a b a c " * 900)]


def test_matches_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as start", "'x' as collapsed", "3 as id").repartition(3)
    got = P.digest(P.scan(df, order=P.planted_order))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute(*d) for d in docs), key=str)
    assert sum(d[0] % 1 == 0 and P.planted_order(d[0], 50) is not None for d in docs) > 5
    assert P.scan(df.limit(0)).count() == 0


def test_general_results(spark):
    df = spark.createDataFrame([(None, "go " + "x y z " * 5 + "end"), (None, None)], "k string, body string")
    rows = {r.n_words: r for r in P.scan(df, "k", "body").collect()}
    assert [tuple(x) for x in rows[17].runs] == [(1, 15, 3)] and rows[17].collapsed == "go x y z end"
    assert rows[0].runs == [] and rows[0].collapsed == ""
    assert [tuple(x) for x in P.scan(df, "k", "body", least=4).where("n_words > 0").first().runs] == [(1, 15, 3)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.sampled_from([2, 4, 12]))
def test_any_sequence(w, least):
    assert P.runs_of(np.array(w, np.int32), least) == brute_runs(w, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_any_repetition(parts):
    w = [x for base, k in parts for x in base * k]
    assert P.runs_of(np.array(w, np.int32)) == brute_runs(w)


def test_portions_of_the_grid_and_long_texts(monkeypatch):
    r = random.Random(4)
    base = [r.randrange(50) for _ in range(700)]
    w = np.array([r.randrange(50) for _ in range(300)] + base * 3 + base[:99] + [1, 2] * 40 + [7] * 500, np.int32)
    want = brute_runs(w.tolist())
    assert len(want) >= 3 and P.runs_of(w) == want
    monkeypatch.setattr(P, "PROBES", 64)
    assert P.runs_of(w) == want


def test_hostile_texts_end():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20000:
        fib.append(fib[-1] + fib[-2])
    assert len(P.runs_of(np.array(fib[-1][:3000]))) == len(brute_runs(fib[-1][:3000]))
    assert P.runs_of(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    assert len(P.runs_of(np.array(([0] * 50 + [1]) * 100 + list(range(2, 2000))))) == len(brute_runs(([0] * 50 + [1]) * 100 + list(range(2, 2000))))
