"""Registered queries over the given tables, each with SQL that gives the same rows where SQL can."""

from . import aggregation, curation, filters, joining, linking, resolving, retrieving, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
