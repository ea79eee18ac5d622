"""Registered queries against their SQL twins. GRAINMILL_TESTS=all runs every query, else the bench's headline ones."""

import os

import pytest

import compare
from bench import HEADLINE
from grainmill.workloads import ORACLES, QUERIES, load_all

load_all()
FOLDER = os.environ.get("GRAINMILL_TESTDATA", "/root/testdata/sf0.001")
NAMES = list(QUERIES) if os.environ.get("GRAINMILL_TESTS") == "all" else list(HEADLINE)


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert compare.compare(name, spark, duck, FOLDER) is None


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(ORACLES) > 300
