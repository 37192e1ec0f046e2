"""Queries of this folder next to their SQL twins."""

from __future__ import annotations

import pytest
from compare import compare, connect
from made import SF_DIR

from timetab.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, name):
    rows, problems = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert not problems and rows > 0, problems
