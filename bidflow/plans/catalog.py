"""All registered queries of the procurement engine, with their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = ("reading", "scalars", "changing", "paging", "extracting", "records", "operations", "wording", "keeping", "storing")


def _modules():
    return [import_module(f"bidflow.plans.{m}") for m in MODULES]


def queries() -> dict:
    found: dict = {}
    for m in _modules():
        if twice := found.keys() & m.SQL.keys():
            raise ValueError(f"registered twice: {', '.join(sorted(twice))}")
        found |= {name: getattr(m, name) for name in m.SQL}
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
