import random
from zlib import crc32

import numpy as np

from tessera.llm import quality_model as Q
from tessera.llm import toxicity as X


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    return float(np.mean([(score[y == 1][:, None] > score[y == 0]) + 0.5 * (score[y == 1][:, None] == score[y == 0])]))


def corpus(n=900):
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic, good = int(r.random() < 0.15), int(r.random() < 0.8)
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["Nasty", "vile", "zzgrim" + r.choice(vocab)])
        t = " ".join(w) if good else "### ".join(w)
        docs.append((i, t))
        if i % 2:
            labels.append((i, good, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (5000, None), (5001, ""), (5002, "vile " * 30000), (1, docs[1][1])], "doc_id long, text string").selectExpr("*", "'q' as score", "1 as id", "2 as x")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (77777, None, None)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for name, k, out in (("toxic", 1, X.verdicts(d, lab)), ("quality", 0, Q.verdicts(spark, d, lab))):
        rows = out.collect()
        assert len(rows) == len(docs) + 4 and all(0 <= x.score <= 1 for x in rows)
        assert all(x.held_out == (crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
        assert all(x.predicted == int(x.score >= (0.3 if k else 0.7)) for x in rows)
        test = [x for x in rows if x.held_out and x.doc_id in truth]
        assert auc([x.score for x in test], [truth[x.doc_id][k] for x in test]) > 0.95, name
        one = [x.score for x in rows if x.doc_id == 1]
        assert len(one) == 2 and one[0] == one[1]


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(i, 1 - q, 1 - t) if crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in labels]
    for f in (lambda x: X.verdicts(d, x), lambda x: Q.verdicts(spark, d, x)):
        a, b = (sorted(map(tuple, f(spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flip))
        assert a == b


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.score for x in X.verdicts(d, none).collect()} == {0.0}
    assert {x.score for x in Q.verdicts(spark, d, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {x.score for x in Q.verdicts(spark, d, one).collect()} <= {0.5, 1.0}
    assert X.verdicts(d.limit(0), one).count() == 0 and Q.verdicts(spark, d.limit(0), one).count() == 0


def test_risk_and_its_gradient():
    """The risk against its definition, example by example, and the gradient against differences; below zero the bracket is stepped against."""
    r = np.random.default_rng(3)
    below = 0
    for _ in range(40):
        xp, xu = (r.integers(0, 2, (n, 4)).astype(float) for n in (int(r.integers(1, 6)), int(r.integers(1, 9))))
        w, b, prior = r.normal(0, 2, 4), float(r.normal()), float(r.uniform(0.05, 0.5))

        def parts(w, b):
            f = lambda x: sum(x[i] * w[i] for i in range(4)) + b
            plus = np.mean([np.log(1 + np.exp(-f(x))) for x in xp])
            minus = np.mean([np.log(1 + np.exp(f(x))) for x in xu]) - prior * np.mean([np.log(1 + np.exp(f(x))) for x in xp])
            return prior * plus, minus

        value, (g, gb) = X.risk(xp, xu, w, b, prior)
        plus, minus = parts(w, b)
        assert abs(value - plus - max(0, minus)) < 1e-9
        step = (lambda w, b: sum(parts(w, b))) if minus >= 0 else (lambda w, b: -parts(w, b)[1])
        below += minus < 0
        for i in range(4):
            e = np.eye(4)[i] * 1e-6
            assert abs((step(w + e, b) - step(w - e, b)) / 2e-6 - g[i]) < 1e-5
        assert abs((step(w, b + 1e-6) - step(w, b - 1e-6)) / 2e-6 - gb) < 1e-5
    assert below
    weights, bias = X.fit(np.ones((40, 2)), np.zeros((0, 2)), 0.1)
    assert np.isfinite(bias) and np.isfinite(weights).all()


def test_density_ratio_is_the_gaussians():
    """Scores against the two densities written out, with each class's shrunk covariance."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (60, 3)), r.normal(1, 2, (90, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]])])
    y = np.repeat([0, 1], [60, 90])
    model = Q.fit(x, y, shrink=0.2, floor=0.05)
    pooled = sum(((p - p.mean(axis=0)) ** 2).sum(axis=0) for p in (x[:60], x[60:])) / 150 + 0.05**2
    log = []
    for p in (x[:60], x[60:]):
        cov = 0.8 * np.cov(p.T) + 0.2 * np.diag(pooled)
        d = x - p.mean(axis=0)
        log.append(np.log(len(p) / 150) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))
    assert np.allclose(model.score(x), model.score(x[::-1])[::-1])


def test_what_comes_to_the_driver_is_bounded(spark):
    """Long texts and an id repeated many times give one row of bits each."""
    docs, labels = corpus(300)
    docs = [(i, t * 30) for i, t in docs] + [(1, "vile nasty words again")] * 500
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.train(d, lab, max_toxic=10, max_unlabelled=20)
    assert len(model.keys) <= X.FEATURES and len(model.base) <= len(model.keys)
    again = X.train(d.repartition(7), lab, max_toxic=10, max_unlabelled=20)
    assert (model.weights == again.weights).all() and model.bias == again.bias
