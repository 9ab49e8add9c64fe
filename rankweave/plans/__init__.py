"""Registered queries over the given tables, grouped as the operators are."""

from __future__ import annotations

import importlib

_MODULES = ("scans", "pairs", "joins", "aggregations", "windows", "scalars", "inference", "integrity", "streams")


def _load():
    for name in _MODULES:
        importlib.import_module(f"rankweave.plans.{name}")
    return importlib.import_module("rankweave.plans.registry")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracles() -> dict[str, str]:
    registry = _load()
    return {name: registry.with_ctes(sql) for name, sql in registry.ORACLES.items()}
