"""Entity registry: same-as links, identifiers, relationships with inverses and expiry, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from .cut import cut


def canonical(same_as: DataFrame) -> DataFrame:
    """(entity, canonical) of links (source, target, retracted): the entity a chain of links ends at.

    Pointer doubling: each round halves the chains. Links that run in a circle raise.
    """
    step = same_as.where("not coalesce(retracted, false)").groupBy("source").agg(F.min("target").alias("target"))
    state = cut(step.select(F.col("source").alias("entity"), F.col("target").alias("canonical")))
    for _ in range(64):
        hop = state.select(F.col("entity").alias("canonical"), F.col("canonical").alias("further"))
        new = cut(state.join(hop, "canonical", "left").select("entity", F.coalesce("further", "canonical").alias("canonical"), F.col("further").isNotNull().alias("moved")))
        if not new.where("entity = canonical").isEmpty():
            raise ValueError("same-as links run in a circle")
        if new.where("moved").isEmpty():
            return new.select("entity", "canonical")
        state = new.select("entity", "canonical")
    raise ValueError("same-as links run in a circle")


def related(relationships: DataFrame, kinds: DataFrame, now: str) -> DataFrame:
    """(entity, kind, other, direction) in both directions, inverse kinds by ``kinds`` (kind, inverse);
    relationships that expired before ``now`` are left out."""
    live = relationships.where(F.col("expires").isNull() | (F.col("expires") > F.lit(now).cast("timestamp")))
    out = live.select(F.col("source").alias("entity"), "kind", F.col("target").alias("other"), F.lit("out").alias("direction"))
    back = live.join(kinds, "kind", "left").select(F.col("target").alias("entity"), F.coalesce("inverse", "kind").alias("kind"), F.col("source").alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(back)


def near(locations: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Locations within a radius, nearest first."""
    rows = locations.where(M.within_radius(F.col("lat"), F.col("lon"), lat, lon, metres))
    return rows.withColumn("metres", M.haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).orderBy("metres")


def by_identifier(identifiers: DataFrame, namespace: str, value: str) -> DataFrame:
    return identifiers.where((F.col("namespace") == namespace) & (F.lower("value") == value.lower())).select("entity").distinct()


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(entity, score) of two scored hit lists: a full outer join, a missing score counts 0."""
    a, b = text_hits.select("entity", F.col("score").alias("t")), vector_hits.select("entity", F.col("score").alias("v"))
    return a.join(b, "entity", "full").select("entity", ((1 - alpha) * F.coalesce("t", F.lit(0.0)) + alpha * F.coalesce("v", F.lit(0.0))).alias("score"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph (source, dest): nodes without a predecessor have level 0."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("dest")).distinct()
    left, rest, out = cut(edges.select("source", "dest").distinct()), cut(nodes), None
    for level in range(10_000):
        ready = cut(rest.join(left.select(F.col("dest").alias("node")), "node", "left_anti"))
        if ready.isEmpty():
            break
        found = ready.withColumn("level", F.lit(level))
        out = found if out is None else out.unionByName(found)
        rest = cut(rest.join(ready, "node", "left_anti"))
        left = cut(left.join(ready.withColumnRenamed("node", "source"), "source", "left_anti"))
    if not rest.isEmpty():
        raise ValueError("the graph has a cycle")
    return out if out is not None else nodes.withColumn("level", F.lit(0))
