"""Registered queries, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

import importlib

from catalog.registry import ORACLES, QUERIES

SECTIONS = ["ingest", "scalars", "joins", "windows", "aggregates", "strategies"]


def _load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"catalog.{section}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
