"""Queries of the subpackage against their SQL on whole tables."""

import pytest
from oracle_check import connect, duck_rows, spark_rows

from calibrant.llm import catalog, oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(catalog.queries()[name](spark, SMALL)) == duck_rows(connect(SMALL), oracle.oracle_sql()[name])
