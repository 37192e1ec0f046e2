"""The registered queries of this folder."""

from __future__ import annotations

import re

import __spark_entry__ as entry

from timetab.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(names) == set(QUERIES)
    assert "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())
