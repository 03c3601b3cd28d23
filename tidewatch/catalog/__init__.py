"""Registered queries over a data folder, each with the DuckDB SQL that must agree where SQL can say it."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all modules."""
    from . import board_queries, detect_queries, function_queries, ingest_queries, lifecycle_queries  # noqa: F401
    from . import report_queries, source_queries, stream_queries, window_queries  # noqa: F401
    from .base import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
