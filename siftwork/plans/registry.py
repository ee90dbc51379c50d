"""Queries over the driver's tables and their SQL equivalents."""

from __future__ import annotations

import importlib

MODULES = ("node_queries", "text_queries", "python_queries", "decision_queries", "record_queries", "stream_queries", "file_queries")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
