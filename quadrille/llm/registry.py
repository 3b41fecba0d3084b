"""Queries of the training-data operators and the SQL that states their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query modules; each has QUERIES and may have ORACLES.
MODULES = ["toxicity_query", "license_scan_query", "language_id_query", "media_query", "mixing_query", "embedding_dedup_query", "byte_bpe_query", "minhash_query", "quality_query", "warc_query"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"quadrille.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"quadrille.llm.{name}"), "ORACLES", {})
    return found
