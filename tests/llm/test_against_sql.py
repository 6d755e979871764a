import pytest

from lodeseam.llm import catalog

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name]))
