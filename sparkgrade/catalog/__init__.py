"""The catalogue: every query bound to the test tables, with its SQL twin."""

from sparkgrade.catalog import audits, building, grades, jobs, scores, upkeep, values, words  # noqa: F401
from sparkgrade.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
