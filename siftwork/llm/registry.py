"""All queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("langid", "parsing", "packing", "media", "licenses", "suffixes", "jaccard", "substrings", "mixing", "toxicity", "hyperminhash", "manifest", "clusters")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
