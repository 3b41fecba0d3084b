"""The star-schema tables as a graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..engine import Engine
from .store import TableMap, TableStore

# Keys of the tables, and foreign keys with the tables they refer to.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "pages": ["page_id"],
}
REFS = {
    "nation": {"n_regionkey": "region"},
    "customer": {"c_nationkey": "nation"},
    "supplier": {"s_nationkey": "nation"},
    "orders": {"o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
}
PREFIXES = {"col": "urn:col:", "ref": "urn:ref:", "tab": "urn:table:", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}


def star_store(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> TableStore:
    names = tables or list(KEYS)
    return TableStore(spark, [TableMap(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), KEYS[n], REFS.get(n, {})) for n in names])


def star_engine(spark: SparkSession, sf_dir: str, tables: list[str] | None = None, **more) -> Engine:
    return Engine(star_store(spark, sf_dir, tables), PREFIXES, **more)


def quad_engine(spark: SparkSession, sf_dir: str, tables: list[str], **more) -> Engine:
    """The same graph as quads."""
    return Engine(star_store(spark, sf_dir, tables).materialised(), PREFIXES, **more)
