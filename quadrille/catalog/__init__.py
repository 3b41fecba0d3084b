"""Registered queries of the engine and the SQL that states their results."""

from __future__ import annotations

from importlib import import_module

MODULES = ["patterns", "functions_catalog", "graph_ops", "search_catalog", "updates_catalog", "kg_catalog"]


def collected(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"quadrille.catalog.{module}"), name)
    return out
