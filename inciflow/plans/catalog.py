"""All registered queries."""

from __future__ import annotations

from . import formula_queries, page_queries, store_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
