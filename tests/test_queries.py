"""Every query against its SQL, at the smallest scale."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from harvestry.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, con, name):
    assert compare(spark, con, SF, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name]).startswith("ok ")


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 10
