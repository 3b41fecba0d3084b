"""Objects of the knowledge graph as sets of quads: validation, and create, update and delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from . import derived as D
from .cut import cut
from .kgquery import ENTITY, FRAME_TYPE
from .updates import delete, insert

MAX_DEPTH = 100


def roles(quads: DataFrame) -> DataFrame:
    """(node, role, g): entity, frame, slot or edge, by what a node says of itself."""
    p, o = F.col("p"), F.col("o")
    role = F.when((p == T.iri(T.RDF_TYPE)) & (o == T.iri(ENTITY)), "entity").when(p == T.iri(FRAME_TYPE), "frame").when(p == T.iri(D.SLOT_TYPE), "slot").when(p == T.iri(D.EDGE_SOURCE), "edge")
    return quads.select(F.col("s").alias("node"), role.alias("role"), "g").where("role is not null").distinct()


def reached(quads: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, node, g): entities with themselves and the frames and slots that edges tie to them, at any
    depth, by rounds from the entities. Only what a round finds is kept."""
    parts = quads.where(_is_part()).select(F.col("s").alias("node"), "g")
    known = level = cut(roles(quads).where("role = 'entity'").select(F.col("node").alias("entity"), "node", "g"))
    for _ in range(MAX_DEPTH):
        met = cut(level.join(edges, (level["node"] == edges["source"]) & (level["g"] == edges["g"])).select("entity", F.col("dest").alias("node"), level["g"]).distinct())
        # the parts are many, so they are thinned to what was met; a semi join of them would be done for each triple of a mapped store
        own = parts.join(met.select("node", "g").distinct(), ["node", "g"])
        level = cut(met.join(own, ["node", "g"], "left_semi").join(known, ["entity", "node", "g"], "left_anti"))
        if level.isEmpty():
            break
        known = cut(known.unionByName(level))
    return known


def graph_members(quads: DataFrame) -> DataFrame:
    """(entity, node, g): entities with the frames, slots and edges that edges tie to them, at any depth;
    an edge node belongs to the entity its source belongs to."""
    edges = cut(D.edges(quads))
    known = reached(quads, edges)
    parts = roles(quads).where("role in ('frame', 'slot')").select("node", "g")
    own = known.withColumnRenamed("node", "source")
    inner = edges.join(own, ["source", "g"]).join(parts.withColumnRenamed("node", "dest"), ["dest", "g"], "left_semi")
    return known.unionByName(inner.select("entity", F.col("edge").alias("node"), "g")).distinct()


def invalid(quads: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(node, problem): what keeps a set of objects from being whole entity graphs; ``links`` is the edge
    table of these quads, if there is one.

    orphan: a frame or slot that no entity reaches; shared: one that several entities reach; dangling: an
    edge whose source or destination is not among the subjects; half: an edge without one of its ends.
    """
    known = reached(quads, cut(D.edges(quads)) if links is None else links)
    # rows of a node are brought together once, before they are added up, as most are alone where they are read;
    # marks are numbers, which need no sort
    parts = quads.where(_is_part()).select(F.col("s").alias("node"), "g", F.lit(1).alias("part"), F.lit(0).alias("n"))
    met = known.groupBy("node", "g").agg(F.count_distinct("entity").cast("int").alias("n")).select("node", "g", F.lit(0).alias("part"), "n")
    state = parts.unionByName(met).repartition("node").groupBy("node", "g").agg(F.max("part").alias("part"), F.max("n").alias("n")).where("part = 1")
    state = state.groupBy("node").agg(F.min("n").alias("fewest"), F.max("n").alias("most"))
    problem = lambda test, name: F.when(test, F.lit(name))
    both = state.select("node", F.explode(F.array_compact(F.array(problem(F.col("fewest") == 0, "orphan"), problem(F.col("most") > 1, "shared")))).alias("problem"))
    ends = quads.where(F.col("p").isin(T.iri(D.EDGE_SOURCE), T.iri(D.EDGE_DEST))).select(F.col("s").alias("node"), (F.col("p") == T.iri(D.EDGE_SOURCE)).cast("int").alias("first"), F.col("o").alias("end"))
    marks = quads.select(F.col("s").alias("end"), F.lit(1).alias("subject"), F.lit(0).alias("used")).unionByName(ends.select("end", F.lit(0).alias("subject"), F.lit(1).alias("used")))
    missing = cut(marks.where("end is not null").repartition("end").groupBy("end").agg(F.max("subject").alias("subject"), F.max("used").alias("used")).where("subject = 0 and used = 1").select("end"))
    half = ends.select("node", "first").repartition("node").groupBy("node").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low = high").select("node", F.lit("half").alias("problem"))
    found = both.unionByName(half)
    if missing.isEmpty():
        return found
    return found.unionByName(ends.join(missing, "end").select("node", F.lit("dangling").alias("problem")).distinct())


def _is_part():
    """Whether a quad says that its subject is a frame or a slot."""
    return F.col("p").isin(T.iri(FRAME_TYPE), T.iri(D.SLOT_TYPE))


def create(quads: DataFrame, objects: DataFrame) -> DataFrame:
    """Add objects; one whose subject exists already is an error."""
    taken = objects.select("s", "g").distinct().join(quads, ["s", "g"], "left_semi").limit(5).collect()
    if taken:
        raise ValueError(f"objects exist: {[r.s for r in taken]}")
    return insert(quads, objects)


def replace(quads: DataFrame, objects: DataFrame, upsert: bool = True) -> DataFrame:
    """Put objects in place of those of the same subjects; without ``upsert`` all must exist."""
    own = objects.select("s", "g").distinct()
    if not upsert:
        missing = own.join(quads, ["s", "g"], "left_anti").limit(5).collect()
        if missing:
            raise ValueError(f"objects do not exist: {[r.s for r in missing]}")
    return insert(quads.join(own, ["s", "g"], "left_anti").select("s", "p", "o", "g"), objects)


def remove(quads: DataFrame, nodes: DataFrame, whole: bool = True) -> DataFrame:
    """Without the objects ``nodes`` (s), with what else belongs to entities among them if ``whole``, and
    without edges to them."""
    gone = nodes.select("s").distinct()
    if whole:
        members = graph_members(quads).join(gone.select(F.col("s").alias("entity")), "entity", "left_semi")
        gone = gone.unionByName(members.select(F.col("node").alias("s"))).distinct()
    gone = cut(gone)
    ends = quads.where(F.col("p").isin(T.iri(D.EDGE_SOURCE), T.iri(D.EDGE_DEST))).join(gone.withColumnRenamed("s", "o"), "o", "left_semi").select("s")
    return delete(quads, quads.join(gone.unionByName(ends).distinct(), "s", "left_semi"))
