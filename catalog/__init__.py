"""Registered queries over the test tables, each with its SQL twin where SQL can say the same."""

from catalog.base import ORACLES, QUERIES
from catalog import boards, cleaning, encoders, features, jobs, models, neighbours, scores, sources, splits, large  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
