import pytest

from memlake import catalogue
from oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_oracle(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    frame = catalogue.QUERIES[name](spark, SF)
    rows = frame.collect()
    assert frame.columns and (rows or name in ("consolidation_clusters",))
