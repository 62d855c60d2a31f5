"""Queries over the test tables, each with the SQL it is held against where SQL can express it."""

from . import admin, histories, metrics, persisted, reports, states, streams, texts, typed  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
