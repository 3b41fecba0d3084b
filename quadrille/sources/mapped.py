"""Tables as graphs of any shape: rows as quads, edges and slots by rules, without a copy of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import derived as D
from .store import DEFAULT_GRAPH, QuadStore


@dataclass
class RowMap:
    """What a row says: ``triples`` (subject, predicate, object), ``edges`` (edge, source, destination) and
    ``slots`` (frame, slot, slot type, property, value). Predicates and properties are IRIs, all else columns
    of canonical terms. Edges and slots are triples too; a slot needs an edge from its frame."""

    df: DataFrame
    triples: list[tuple[Column, str, Column]] = field(default_factory=list)
    edges: list[tuple[Column, Column, Column]] = field(default_factory=list)
    slots: list[tuple[Column, Column, Column, str, Column]] = field(default_factory=list)

    def every(self) -> list[tuple[Column, str, Column]]:
        ends = [t for e, a, b in self.edges for t in ((e, D.EDGE_SOURCE, a), (e, D.EDGE_DEST, b))]
        filled = [t for _, s, kind, p, v in self.slots for t in ((s, D.SLOT_TYPE, kind), (s, p, v))]
        return [*self.triples, *ends, *filled]


class MappedStore(QuadStore):
    """Quads of tables. Each triple of a map is a select of its own with a constant predicate, so a scan for
    some predicates reads the columns of these alone; the edge and slot tables are selects as well.
    ``counts`` are the rows of the maps' tables, as far as known."""

    def __init__(self, spark: SparkSession, maps: list[RowMap], counts: list[int | None]):
        g = F.lit(DEFAULT_GRAPH).alias("g")
        quads, edges, slots, statistics = [], [], [], {}
        for m, n in zip(maps, counts, strict=True):
            for s, p, o in m.every():
                quads.append(m.df.select(s.alias("s"), F.lit(T.iri(p)).alias("p"), o.alias("o"), g))
                statistics[T.iri(p)] = statistics.get(T.iri(p), 0) + (n or 1_000_000)
            for e, a, b in m.edges:
                row = m.df.select(e.alias("edge"), a.alias("source"), b.alias("dest"), g)
                edges.append(row.where("source is not null and dest is not null"))
            for f, s, kind, p, v in m.slots:
                row = m.df.select(f.alias("frame"), s.alias("slot"), kind.alias("slot_type"), F.lit(T.iri(p)).alias("property"), v.alias("value"), g)
                slots.append(row.where("frame is not null and slot is not null and slot_type is not null"))
        tables = {"edges": edges, "slots": slots}
        super().__init__(reduce(DataFrame.unionAll, quads), statistics, derived={k: reduce(DataFrame.unionAll, v) for k, v in tables.items() if v})
