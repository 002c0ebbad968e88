import numpy as np
from pyspark.sql import functions as F

from tessera.llm import sieve


def test_partners_always_pass(spark):
    rows = spark.range(5000).selectExpr("id", "1 as _word", "2 as word", "3 as bits", "4 as at")
    some = spark.range(0, 5000, 50)
    maybe, other = sieve.split(rows, F.xxhash64("id"), some, F.xxhash64("id"))
    assert maybe.columns == other.columns == rows.columns
    assert {r.id for r in some.collect()} <= {r.id for r in maybe.collect()}
    assert maybe.count() < 150 and maybe.count() + other.count() == 5000
    assert sieve.split(rows, F.xxhash64("id"), some.limit(0), F.xxhash64("id"))[0].count() == 0
    assert sieve.split(rows, F.xxhash64("id"), rows, F.xxhash64("id"))[1].count() == 0


def test_bits_in_tasks_are_the_same(spark):
    some = spark.range(0, 5000, 50)
    bits = sieve.bitmap(some, F.xxhash64("id"))
    keys = np.array([r.k for r in spark.range(5000).select(F.xxhash64("id").alias("k")).collect()], np.int64).view(np.uint64)
    ok = sieve.passes(bits, keys)
    assert ok[::50].all() and ok.sum() < 150
