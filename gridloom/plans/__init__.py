"""Composed analyses and the registry of named queries."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ["manifest", "cube", "intrinsic", "sample", "token", "score", "report"]


def _load():
    for group in _GROUPS:
        import_module(f"gridloom.plans.{group}_queries")
    from gridloom.plans import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
