"""Every registered query agrees with its SQL twin on the smallest tables."""

import pytest

from oracle import compare, connect
from ruleweave.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, _, same, note = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert same is not False, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
