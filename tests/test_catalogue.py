import pytest

from tessera.plans.catalogue import ORACLE, QUERIES
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE[name])
