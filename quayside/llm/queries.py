"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("residue", "personal", "split", "canon", "neardup", "language", "encode", "mixing", "reading")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= getattr(importlib.import_module(f"quayside.llm.{name}"), attribute, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
