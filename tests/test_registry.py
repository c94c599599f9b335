"""Every registered query against its SQL, and the shape of the registry itself."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 180


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, duck):
    assert compare(duck, spark, SF_DIR, QUERIES[name], ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
