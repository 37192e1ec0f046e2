"""Every registered query runs, and equals its SQL twin where it has one."""

import pytest
from compare import compare, connect

from catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 70


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problems = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert not problems, problems
    assert rows > 0
