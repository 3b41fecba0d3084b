"""SPARQL updates on immutable snapshots: a new set of quads is a function of the old one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine, instantiate
from ..functions import terms as T
from ..plans import algebra as A
from ..plans.parser import Parser
from ..sources.store import DEFAULT_GRAPH, QUAD_SCHEMA, Dataset, QuadStore
from .cut import cut

KEYS = ["s", "p", "o", "g"]


class UpdateError(ValueError):
    pass


def _graph(ref: str) -> str:
    return DEFAULT_GRAPH if ref == "DEFAULT" else T.iri(ref)


def ground(spark, template: list, fresh: bool) -> DataFrame:
    """INSERT DATA and DELETE DATA quads; blank nodes are fresh for each INSERT DATA."""
    import uuid

    tag = uuid.uuid4().hex
    rows = []
    for s, p, o, g in template:
        cells = [x.text if isinstance(x, A.Term) else T.blank(f"{tag}{x.name[2:]}") for x in (s, p, o)]
        if not fresh and any(isinstance(x, A.Var) for x in (s, p, o)):
            raise UpdateError("blank nodes in DELETE DATA")
        rows.append((*cells, DEFAULT_GRAPH if g is None else g.text))
    return spark.createDataFrame(rows, QUAD_SCHEMA)


def insert(quads: DataFrame, more: DataFrame) -> DataFrame:
    return quads.unionByName(more.select(KEYS)).dropDuplicates(KEYS)


def delete(quads: DataFrame, less: DataFrame) -> DataFrame:
    return quads.join(less.select(KEYS).distinct(), KEYS, "left_anti")


def apply_update(quads: DataFrame, text: str, prefixes: dict[str, str] | None = None, graphs: frozenset[str] = frozenset()) -> tuple[DataFrame, frozenset[str]]:
    """Run ``;``-separated operations; returns the new quads and the graphs that CREATE registered."""
    for u in Parser(text, prefixes).update():
        removed, added, graphs = changes(quads, u, graphs)
        quads = quads if removed is None else delete(quads, removed)
        quads = quads if added is None else insert(quads, added)
    return quads, graphs


#: Pairs of predicate and graph up to which old quads are thinned to those of the changes.
MOST_KINDS = 1000


def effects(quads: DataFrame, text: str, prefixes: dict[str, str] | None = None, graphs: frozenset[str] = frozenset()) -> DataFrame:
    """(s, p, o, g, change): what ``;``-separated operations add to a set of quads and remove from it.

    Only what they touch is brought together, the last mark of a quad tells whether it is there, and of the
    old quads those are looked up that have a predicate and a graph of a touched one.
    """
    marks = []

    def touched() -> DataFrame:
        return reduce(DataFrame.unionByName, marks).groupBy(*KEYS).agg(F.max("mark").alias("mark"))

    there = F.col("mark") % 2 == 1
    for n, u in enumerate(Parser(text, prefixes).update()):
        now = quads.select(KEYS)
        if marks:
            now = now.join(touched(), KEYS, "left_anti").unionByName(touched().where(there).select(KEYS))
        removed, added, graphs = changes(now, u, graphs)
        # what is added wins over what is removed
        marks += [rows.select(*KEYS, F.lit(2 * n + k).alias("mark")) for k, rows in enumerate((removed, added)) if rows is not None]
    if not marks:
        return quads.limit(0).select(*KEYS, F.lit("").alias("change"))
    kinds = touched().select("p", "g").distinct().limit(MOST_KINDS + 1).collect()
    old = quads.select(KEYS)
    if len(kinds) <= MOST_KINDS:
        old = old.where(F.col("p").isin([r.p for r in kinds]) & F.col("g").isin([r.g for r in kinds]))
    had = old.join(touched().select(KEYS), KEYS, "left_semi").distinct().withColumn("had", F.lit(True))
    out = touched().join(had, KEYS, "left").where(there != F.col("had").isNotNull())
    return out.select(*KEYS, F.when(there, "added").otherwise("removed").alias("change"))


def changes(quads: DataFrame, u: A.Update, graphs: frozenset[str], indexes: dict | None = None, embed=None) -> tuple[DataFrame | None, DataFrame | None, frozenset[str]]:
    """(removed, added, graphs) of one operation: quads to take away, then quads to put in, None without any."""
    spark, g = quads.sparkSession, F.col("g")
    match u.kind:
        case "insert_data":
            return None, ground(spark, u.insert, True), graphs
        case "delete_data":
            return ground(spark, u.delete, False), None, graphs
        case "modify":
            using = tuple(map(T.iri, u.using)) if u.using or u.using_named else (T.iri(u.within),) if u.within else None
            named = tuple(map(T.iri, u.using_named)) if u.using or u.using_named else None
            engine = Engine(QuadStore(quads), indexes=indexes, embed=embed)
            s = engine.builder().build(u.pattern, Dataset(using, named))
            s.df = cut(s.df)  # both templates see the bindings of the old snapshot, evaluated once
            gone = instantiate(u.delete, s, True)
            if gone is not None and using is None and any(t[3] is None for t in u.delete):
                # without a graph the pattern saw the union of all, and so does the deletion
                loose = instantiate([t for t in u.delete if t[3] is None], s, False)
                gone = gone.unionByName(quads.join(loose.distinct(), ["s", "p", "o"], "left_semi").select(KEYS))
            return gone, instantiate(u.insert, s, True), graphs
        case "clear":
            match u.target:
                case "ALL":
                    return quads, None, frozenset()
                case "NAMED":
                    return quads.where(g != DEFAULT_GRAPH), None, graphs
                case _:
                    return quads.where(g == _graph(u.target)), None, graphs - {_graph(u.target)}
        case "create":
            name = T.iri(u.target)
            if not u.silent and (name in graphs or not quads.where(g == name).isEmpty()):
                raise UpdateError(f"graph <{u.target}> exists")
            return None, None, graphs | {name}
        case "copy" | "move" | "add":
            source, target = _graph(u.source), _graph(u.target)
            if source == target:
                return None, None, graphs
            gone = {"copy": g == target, "move": g.isin(source, target), "add": None}[u.kind]
            moved = quads.where(g == source).withColumn("g", F.lit(target)).select(KEYS)
            return None if gone is None else quads.where(gone), moved, graphs
        case "load":
            from ..sources.rdf_files import read_rdf

            try:
                return None, read_rdf(spark, u.source.removeprefix("file://"), graph=None if u.target is None else T.iri(u.target)), graphs
            except Exception:
                if u.silent:
                    return None, None, graphs
                raise
    raise UpdateError(f"unknown update {u.kind}")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s, p, o, g, change): what was added and removed between two snapshots."""
    added = new.select(KEYS).exceptAll(old.select(KEYS)).withColumn("change", F.lit("added"))
    return added.unionByName(old.select(KEYS).exceptAll(new.select(KEYS)).withColumn("change", F.lit("removed")))

