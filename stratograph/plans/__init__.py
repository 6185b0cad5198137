"""All registered queries and their SQL."""

from __future__ import annotations

from ..registry import Query


def _registries():
    from . import agents, clustering, graph, lookup, quality, storage, text

    return [lookup.R, graph.R, quality.R, text.R, storage.R, clustering.R, agents.R]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for r in _registries():
        out |= r.queries
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for r in _registries():
        out |= r.sql
    return out
