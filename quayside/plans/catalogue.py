"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("quayside.operators.timestamps", "quayside.operators.labels", "quayside.operators.measures", "quayside.operators.strings", "quayside.operators.vectors", "quayside.operators.retrieval")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= getattr(importlib.import_module(name), attribute, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
