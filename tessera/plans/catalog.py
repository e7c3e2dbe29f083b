"""Every core query with its oracle, gathered from the plan modules."""

from __future__ import annotations

from . import claim_queries, evaluation_queries, monitor_queries, prompt_queries, retrieval_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
