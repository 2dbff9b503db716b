"""All queries of the engine, with the SQL that checks them."""

from __future__ import annotations

from . import document_queries, ledger_queries, log_queries, more_queries, retrieval_queries, store_queries, sync_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
