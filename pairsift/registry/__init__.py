"""Named queries over the given tables, each with the SQL that must agree with it."""

from pairsift.registry import cleaning, corpus, evaluation, pairs, scoring  # noqa: F401
from pairsift.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
