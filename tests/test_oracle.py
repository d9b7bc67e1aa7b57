"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from check_oracle import compare, duck
from workload.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query(spark, con, name):
    problem, rows = compare(spark, con, name, SF)
    assert problem is None
    assert rows > 0


def test_every_core_query_has_an_oracle():
    """The training-data queries that SQL cannot express are tested by brute force instead."""
    assert set(ORACLE) == set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 4000
