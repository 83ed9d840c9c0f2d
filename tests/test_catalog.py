"""Every catalogue query against its check SQL on the smallest tables."""

import inspect

import pytest
from check_catalog import connect, difference

import __spark_entry__
from turnloom.plans.catalog import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"
# The smallest tables hold no case for these.
MAY_BE_EMPTY = {"question_overlap"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    problem = difference(spark, duck, SF_DIR, name)
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY)


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).count() == QUERIES["pairs_build"](spark, SF_DIR).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(CHECKS)
    for query in __spark_entry__.queries().values():
        assert len(inspect.signature(query).parameters) == 2
