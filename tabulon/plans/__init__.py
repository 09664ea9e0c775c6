"""Registered queries, one module a family; importing the package registers them all."""

from . import analytics, context, graphs, logs, matching, retrieval
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "context", "graphs", "logs", "matching", "retrieval"]
