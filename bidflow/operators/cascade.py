"""Deletes along foreign keys: a walk of the declared graph, with what each edge does to the rows below.

Tables are walked parents first. A row goes if a key that cascades names a row that goes; a key that is
set to null loses it. Only the keys of rows that go are joined, once an edge, so tables without such rows below cost one
join on a few keys; the graph may have several ways to a table, not cycles.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A foreign key: rows of table name those of parent by a column; what becomes of them if these go."""

    table: str
    column: str
    parent: str
    cascades: bool


# The foreign keys of the store.
KEYS = [
    Key("opportunities", "portal_id", "portals", True),
    Key("opportunity_events", "opportunity_id", "opportunities", True),
    Key("opportunity_events", "run_id", "scrape_runs", False),
    Key("documents", "opportunity_id", "opportunities", True),
    Key("scrape_runs", "portal_id", "portals", False),
    Key("scrape_runs", "scheduled_job_id", "scheduled_jobs", False),
    Key("page_snapshots", "run_id", "scrape_runs", True),
    Key("page_snapshots", "portal_id", "portals", False),
]


def order_of(keys: list[Key]) -> list[str]:
    """Tables, parents before what names them."""
    graph: dict[str, set[str]] = {}
    for k in keys:
        graph.setdefault(k.parent, set())
        graph.setdefault(k.table, set()).add(k.parent)
    return list(TopologicalSorter(graph).static_order())


def delete(tables: Mapping[str, DataFrame], table: str, which: Column, keys: list[Key] = KEYS, id_col: str = "id") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What is left of all tables when the rows of one that meet which are deleted, and the ids of the rows that go from each table touched.

    Null keys name nothing. A condition that is null deletes nothing. Tables that aren't given are taken to be empty.
    """
    left = dict(tables)
    gone: dict[str, DataFrame] = {table: tables[table].where(which).select(id_col)}
    left[table] = tables[table].where(~F.coalesce(which, F.lit(False)))
    for name in order_of(keys):
        edges = [k for k in keys if k.table == name and k.parent in gone and name in tables]
        if not edges:
            continue
        rows, lost = left[name], F.lit(False)
        for i, k in enumerate(edges):
            named = gone[k.parent].select(F.col(id_col).alias(f"__{i}")).distinct()
            rows = rows.join(named, F.col(k.column) == F.col(f"__{i}"), "left")
            if k.cascades:
                lost = lost | F.col(f"__{i}").isNotNull()
        columns = {k.column: F.when(F.col(f"__{i}").isNull(), F.col(k.column)) for i, k in enumerate(edges) if not k.cascades}
        kept = rows.where(~lost).select(*(columns.get(c, F.col(c)).alias(c) for c in tables[name].columns))
        if any(k.cascades for k in edges):
            more = rows.where(lost).select(id_col)
            gone[name] = gone[name].unionByName(more) if name in gone else more
        left[name] = kept
    return left, gone

