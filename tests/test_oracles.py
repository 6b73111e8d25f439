"""Every registered query next to its SQL, on the smallest data folder, on both join paths."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from lorekeep.testbed import registry

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, SF_DIR) in (None, "no rows")


def test_entry_yields_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(registry.all_queries()) == set(registry.all_oracles())
