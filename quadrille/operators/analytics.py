"""What a space holds: distributions over its entities, frames, relations and properties, over all quads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import values as V
from ..functions.values import Val
from . import derived as D
from .kgobjects import roles
from .kgquery import ENTITY_TYPE, FRAME_TYPE, RELATION_TYPE


def _by_object(quads: DataFrame, predicate: str) -> DataFrame:
    """(type, objects): how many subjects have each object of a predicate."""
    rows = quads.where(F.col("p") == T.iri(predicate))
    return rows.groupBy(V.lex(Val("term", F.col("o"))).alias("type")).agg(F.count_distinct("s").alias("objects"))


def entity_types(quads: DataFrame) -> DataFrame:
    return _by_object(quads, ENTITY_TYPE)


def frames_of_entities(quads: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(frames, entities): how many entities have how many frames, those without any included."""
    kinds = roles(quads)
    ties = (D.edges(quads) if links is None else links).join(kinds.where("role = 'frame'").select(F.col("node").alias("dest"), "g"), ["dest", "g"], "left_semi")
    own = ties.groupBy(F.col("source").alias("node"), "g").agg(F.count_distinct("dest").alias("frames"))
    entities = kinds.where("role = 'entity'").select("node", "g")
    return entities.join(own, ["node", "g"], "left").groupBy(F.coalesce("frames", F.lit(0)).alias("frames")).agg(F.count("*").alias("entities"))


def frame_and_slot_types(quads: DataFrame) -> DataFrame:
    """(kind, type, objects) with kind frame or slot."""
    parts = (_by_object(quads, p).withColumn("kind", F.lit(kind)) for kind, p in (("frame", FRAME_TYPE), ("slot", D.SLOT_TYPE)))
    first, second = parts
    return first.unionByName(second).select("kind", "type", "objects")


def frames_without_slots(quads: DataFrame, slots: DataFrame) -> DataFrame:
    """(frames): how many frames no slot is tied to; ``slots`` is the slot table."""
    frames = roles(quads).where("role = 'frame'").select(F.col("node").alias("frame"), "g")
    return frames.join(slots.select("frame", "g"), ["frame", "g"], "left_anti").agg(F.count("*").alias("frames"))


def relation_types(quads: DataFrame) -> DataFrame:
    return _by_object(quads, RELATION_TYPE)


def properties(quads: DataFrame) -> DataFrame:
    """(predicate, datatype, quads, subjects); datatype null for IRIs and blank nodes."""
    o = Val("term", F.col("o"))
    rows = quads.select(F.substr("p", F.lit(2)).alias("predicate"), V.datatype(o).alias("datatype"), "s")
    return rows.groupBy("predicate", "datatype").agg(F.count("*").alias("quads"), F.count_distinct("s").alias("subjects"))
