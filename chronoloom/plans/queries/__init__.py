"""Registered queries with the SQL that states the same result."""

from . import casefiles, facts, intake, scores, stores, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
