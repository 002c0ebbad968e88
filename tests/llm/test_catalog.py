import pytest

from tessera.llm import catalog
from tests.sqlcompare import HAVE, SF_DIR, assert_same, database

pytestmark = pytest.mark.skipif(not HAVE, reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF_DIR), database(), catalog.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert {k.split("_")[0] for k in catalog.QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
