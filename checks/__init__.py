"""Registered queries over the test tables, each beside the SQL it must agree with."""

from checks import answers, corpus, freshness, retrieval, vectors  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
