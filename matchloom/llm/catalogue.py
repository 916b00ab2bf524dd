"""Queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _name in ("near_copies", "canonical", "neighbours", "scans", "pieces", "site_lines", "packing", "mixture", "passages"):
    try:
        _module = importlib.import_module(f"matchloom.llm.{_name}")
    except ModuleNotFoundError as missing:
        if missing.name != f"matchloom.llm.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    ORACLE |= getattr(_module, "ORACLE", {})
