"""Every query against its SQL over whole tables."""

import oracle
import pytest

import __spark_entry__
from textloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name]) == ""


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
