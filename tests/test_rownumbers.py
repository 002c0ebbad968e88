import random

from pyspark.sql import functions as F

from tessera.operators.rownumbers import number_rows


def rows(n=3000):
    r = random.Random(2)
    return [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.choice([None, 0.5, 1.0, float(r.randint(0, 40))]), i) for i in range(n)]


def key(r):
    return (r[1] is not None, r[1] or 0.0, r[2])


def test_numbers_of_all_rows(spark):
    df = spark.createDataFrame(rows(), "g string, v double, i long").repartition(7)
    got = {r.i: r.at for r in number_rows(df, [F.asc_nulls_first("v"), F.asc("i")], name="at").collect()}
    assert got == {r[2]: k + 1 for k, r in enumerate(sorted(rows(), key=key))}


def test_numbers_within_groups(spark):
    df = spark.createDataFrame(rows(), "g string, v double, i long").repartition(7)
    got = {r.i: r.at for r in number_rows(df, [F.asc_nulls_first("v"), F.asc("i")], ["g"], "at").collect()}
    want = {}
    for g in ("a", "b", None, "hot"):
        want |= {r[2]: k + 1 for k, r in enumerate(sorted((r for r in rows() if r[0] == g), key=key))}
    assert got == want


def test_no_group_is_sorted_by_one_task(spark):
    df = spark.createDataFrame(rows(), "g string, v double, i long").repartition(7)
    plans = []

    def keep(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return d.checkpoint()

    out = number_rows(df, [F.asc("v"), F.asc("i")], ["g"], "at", keep)
    assert "rangepartitioning" in plans[0] and "Window" not in plans[0]
    assert out.columns == ["g", "v", "i", "at"] and number_rows(df.limit(0), [F.asc("i")]).count() == 0
