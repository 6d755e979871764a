import pytest

from lodeseam import queries as core

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    assert_same(core.queries()[name](spark, SF), duck.sql(core.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert core.entry(spark, SF).count() >= 0


def test_entry_module_imports_without_a_session():
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_filter_reaches_the_scan_and_columns_are_pruned(spark):
    plan = core.queries()["doc_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
