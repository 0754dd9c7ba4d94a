"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from . import (dashboard_queries, feature_queries, ml_queries, rules_queries, stream_queries,  # noqa: F401
               table_queries, io_queries)
from .base import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
