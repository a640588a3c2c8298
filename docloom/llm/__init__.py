"""Operators of a training-data pipeline. Nothing else in the library imports this."""

from __future__ import annotations

from importlib import import_module

MODULES = ("licenses", "lines", "simhash", "decontaminate", "packing", "neighbours", "fixity", "toxicity", "sharding", "language", "infill", "interaction", "tokenfile")


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__name__}.{name}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
