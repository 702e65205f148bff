import pytest

from compare import rows_of_spark, rows_of_sql
from stratalith import graph_queries, queries, report_queries, search_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(queries.ORACLE_SQL[name], SF)
