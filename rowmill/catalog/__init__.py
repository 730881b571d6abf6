"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from rowmill.catalog import (  # noqa: F401
    changes,
    chunks,
    duplicates,
    expressions,
    files,
    flows,
    lifecycles,
    lists,
    requests,
    statistics,
    streams,
    validation,
)
from rowmill.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
