"""The registered queries of the ranking and evaluation operators, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("ranking", "priors", "calls", "prep", "classify", "analysis", "sources", "running")


def _all(kind: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"shortlister.plans.{m}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
