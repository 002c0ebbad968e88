import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tessera.plans import catalog
from tests.sqlcompare import HAVE, SF_DIR, assert_same, database

pytestmark = pytest.mark.skipif(not HAVE, reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", catalog.NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF_DIR), con, catalog.ORACLE_SQL[name])


def test_otsu_equals_its_sql_on_tied_odd_and_nameless_rasters(spark, tmp_path):
    r, rows = np.random.default_rng(3), []
    for i in range(400):  # symmetric: each level ties with its mirror
        half = r.integers(0, int(r.integers(1, 120)) + 1, 32)
        gray = np.concatenate([half, 240 - half])[: 64 if i % 3 else int(r.integers(1, 65))]
        rows.append(((gray + 0.5) / 232 - 0.55).tolist())
    rows[7][0], rows[8], rows[9] = None, None, []
    ids = [None if i in (0, 1) else i % 390 for i in range(400)]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    con = database()
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert_same(catalog.QUERIES["otsu"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["otsu"])


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["component_verdicts"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "l_quantity" in read and "l_extendedprice" not in read and "l_shipdate" not in read
    assert "partial_count" in plan
