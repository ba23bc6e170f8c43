import pytest
from conftest_helpers import compare

from trackloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])
