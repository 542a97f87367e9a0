"""Named queries over the given tables, each with the SQL it must equal."""

from __future__ import annotations

from importlib import import_module

from ._registry import ORACLES, QUERIES

SECTIONS = ("periods", "sync_runs", "cleaning", "joins", "cube", "query_sets", "layout", "catalog", "ledger")


def _load() -> None:
    for section in SECTIONS:
        import_module(f"{__name__}.{section}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
