"""Tables derived from quads: edges, frame-entity rows, statistics and fan-out, with drift checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T

#: Namespaces of the knowledge-graph model; data in other ones goes through ``in_model``.
CORE = "urn:model:core#"
KG = "urn:model:kg#"
EDGE_SOURCE, EDGE_DEST = CORE + "hasEdgeSource", CORE + "hasEdgeDestination"
NAME = CORE + "hasName"
SLOT_TYPE, SLOT_VALUE = KG + "hasKGSlotType", KG + "hasEntitySlotValue"
SOURCE_SLOT, DEST_SLOT = "urn:hasSourceEntity", "urn:hasDestinationEntity"


def in_model(quads: DataFrame, core: str, kg: str) -> DataFrame:
    """Quads whose model terms lie in the namespaces ``core`` and ``kg``, with the names used here."""
    def renamed(c: str):
        col = F.col(c)
        for old, new in ((core, CORE), (kg, KG)):
            col = F.when(col.startswith("I" + old), F.concat(F.lit("I" + new), F.substr(col, F.lit(len(old) + 2)))).otherwise(col)
        return col.alias(c)

    return quads.select("s", renamed("p"), renamed("o"), "g")


def edges(quads: DataFrame) -> DataFrame:
    """(edge, source, dest, g): nodes with both an edge source and an edge destination, in one pass over
    the two predicates."""
    two = quads.where(F.col("p").isin(T.iri(EDGE_SOURCE), T.iri(EDGE_DEST)))
    one = two.groupBy(F.col("s").alias("edge"), "g").agg(F.max(F.when(F.col("p") == T.iri(EDGE_SOURCE), F.col("o"))).alias("source"), F.max(F.when(F.col("p") == T.iri(EDGE_DEST), F.col("o"))).alias("dest"))
    return one.where("source is not null and dest is not null").select("edge", "source", "dest", "g")


def slots(quads: DataFrame, properties: list[str], links: DataFrame | None = None) -> DataFrame:
    """(frame, slot, slot_type, property, value, g): the values of every slot that an edge ties to a frame;
    ``links`` is the edge table, if there is one."""
    own = quads.where(F.col("p").isin(T.iri(SLOT_TYPE), *map(T.iri, properties)))
    typed = own.where(F.col("p") == T.iri(SLOT_TYPE)).select(F.col("s").alias("slot"), F.col("o").alias("slot_type"), "g")
    valued = own.where(F.col("p") != T.iri(SLOT_TYPE)).select(F.col("s").alias("slot"), F.col("p").alias("property"), F.col("o").alias("value"), "g")
    of = (edges(quads) if links is None else links).select(F.col("source").alias("frame"), F.col("dest").alias("slot"), "g")
    return of.join(typed, ["slot", "g"]).join(valued, ["slot", "g"], "left").select("frame", "slot", "slot_type", "property", "value", "g")


def frame_entities(quads: DataFrame, source_slot: str = SOURCE_SLOT, dest_slot: str = DEST_SLOT) -> DataFrame:
    """(frame, source_entity, dest_entity, g): a frame's slots folded by conditional aggregation."""
    slots = quads.where(F.col("p").isin(T.iri(SLOT_TYPE), T.iri(SLOT_VALUE)))
    slot = slots.groupBy(F.col("s").alias("slot"), "g").agg(F.max(F.when(F.col("p") == T.iri(SLOT_TYPE), F.col("o"))).alias("kind"), F.max(F.when(F.col("p") == T.iri(SLOT_VALUE), F.col("o"))).alias("value"))
    slot = slot.where("kind is not null and value is not null")
    joined = edges(quads).select(F.col("source").alias("frame"), F.col("dest").alias("slot"), "g").join(slot, ["slot", "g"])
    return joined.groupBy("frame", "g").agg(F.max(F.when(F.col("kind") == T.iri(source_slot), F.col("value"))).alias("source_entity"), F.max(F.when(F.col("kind") == T.iri(dest_slot), F.col("value"))).alias("dest_entity")).where("source_entity is not null or dest_entity is not null")


def predicate_stats(quads: DataFrame) -> DataFrame:
    return quads.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("quads"))


def pair_stats(quads: DataFrame, most: int | None = None) -> DataFrame:
    """(predicate, object, quads) of all pairs, or of those with at most ``most`` quads."""
    pairs = quads.groupBy(F.col("p").alias("predicate"), F.col("o").alias("object")).agg(F.count("*").alias("quads"))
    return pairs if most is None else pairs.where(F.col("quads") <= most)


def fan_out(pairs: DataFrame, kinds: list[str], source: str = "source", dest: str = "dest") -> DataFrame:
    """Average, 99th percentile and maximum degree by ``kinds`` and direction."""
    def one(node: str, name: str) -> DataFrame:
        degree = pairs.groupBy(*kinds, node).agg(F.count("*").alias("d"))
        return degree.groupBy(*kinds).agg(F.avg("d").alias("avg_degree"), F.expr("percentile_disc(0.99) within group (order by d)").alias("p99_degree"), F.max("d").alias("max_degree"), F.count("*").alias("nodes")).withColumn("direction", F.lit(name))

    return one(source, "out").unionByName(one(dest, "in"))


def materialised_links(quads: DataFrame, kinds: dict[tuple[str, str], str]) -> DataFrame:
    """Direct predicates for edges by the types of their ends: {(source type, dest type): predicate}."""
    types = quads.where(F.col("p") == T.iri(T.RDF_TYPE)).select("s", F.col("o").alias("t"))
    joined = edges(quads).join(types.select(F.col("s").alias("source"), F.col("t").alias("st")), "source").join(types.select(F.col("s").alias("dest"), F.col("t").alias("dt")), "dest")
    pick = F.coalesce(*(F.when((F.col("st") == T.iri(a)) & (F.col("dt") == T.iri(b)), F.lit(T.iri(p))) for (a, b), p in kinds.items()))
    return joined.select(F.col("source").alias("s"), pick.alias("p"), F.col("dest").alias("o"), "g").where("p is not null")


def drift(kept: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a maintained table lacks (missing) or has beyond the recomputed one (orphan)."""
    a, b = kept.select(keys).withColumn("_kept", F.lit(True)), recomputed.select(keys).withColumn("_new", F.lit(True))
    both = a.join(b, keys, "full")
    return both.where("_kept is null or _new is null").select(*keys, F.when(F.col("_kept").isNull(), "missing").otherwise("orphan").alias("state"))


def same_objects(a: DataFrame, b: DataFrame, ignored: list[str]) -> bool:
    """Whether two graphs are equal apart from the ignored predicates."""
    drop = [T.iri(p) for p in ignored]
    x, y = (d.where(~F.col("p").isin(*drop)).select("s", "p", "o") for d in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
