"""Entity, frame and relation queries: criteria to algebra, run by the engine.

Entities reach frames, frames reach slots and child frames through edge nodes. Criteria become graph
patterns, comparators become filters, and negated criteria anti joins, so a query is a chain of semi
joins whatever the number of criteria.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import terms as T
from ..plans import algebra as A
from .cut import cut
from .derived import EDGE_DEST, EDGE_SOURCE, KG, NAME, SLOT_TYPE, SLOT_VALUE
from .solutions import column_name

FRAME, DOCUMENT, RELATION = KG + "KGFrame", KG + "KGDocument", KG + "KGRelation"
REFERENCE = KG + "hasReferenceIdentifier"
DOCUMENT_TYPE, SEGMENT_INDEX, SEGMENT_TYPE = KG + "hasKGDocumentType", KG + "hasKGDocumentSegmentIndex", KG + "hasKGDocumentSegmentTypeURI"
SEGMENT_METHOD, SEGMENT_TOKENS, PARENT = KG + "hasKGDocumentSegmentMethodURI", KG + "hasKGDocumentSegmentTokenLength", KG + "hasKGDocumentParentURI"
SUMMARY_TYPE = "urn:segtype:segmentation_parent"
ENTITY, ENTITY_TYPE = KG + "KGEntity", KG + "hasKGEntityType"
FRAME_TYPE, RELATION_TYPE = KG + "hasKGFrameType", KG + "hasKGRelationType"
# Comparators, and the slot value property of each value type.
COMPARATORS = ["eq", "ne", "gt", "lt", "gte", "lte", "contains", "exists", "not_exists", "is_empty", "has", "has_any", "has_all", "not_has", "not_has_any"]
VALUE_PROPERTIES = {str: KG + "hasTextSlotValue", int: KG + "hasIntegerSlotValue", float: KG + "hasDoubleSlotValue", bool: KG + "hasBooleanSlotValue"}
SYMBOLS = {"eq": "=", "ne": "!=", "gt": ">", "lt": "<", "gte": ">=", "lte": "<="}


@dataclass
class Slot:
    slot_type: str
    value: object = None
    comparator: str = "eq"
    value_property: str | None = None

    def __post_init__(self):
        if self.comparator not in COMPARATORS:
            raise ValueError(f"unknown comparator {self.comparator}")
        if self.comparator == "contains" and len(str(self.value)) < 3:
            raise ValueError("contains needs three characters at least")

    def property(self) -> str:
        sample = self.value[0] if isinstance(self.value, list) and self.value else self.value
        return self.value_property or VALUE_PROPERTIES.get(type(sample), VALUE_PROPERTIES[str])


@dataclass
class Frame:
    frame_type: str
    slots: list[Slot] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    negate: bool = False


@dataclass
class Search:
    """A search function of the engine over the entity, which must reach ``least``; ``least`` None: a test."""

    function: str
    args: list
    least: float | None = None


@dataclass
class Sort:
    frame_type: str | None = None
    slot_type: str | None = None
    property: str | None = None
    descending: bool = False
    search: Search | None = None


@dataclass
class EntityQuery:
    entity_type: str | None = None
    frames: list[Frame] = field(default_factory=list)
    properties: list[tuple[str, str, object]] = field(default_factory=list)  # (property, comparator, value)
    name_contains: str | None = None
    sort: list[Sort] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    kind: str | None = None  # type of the objects; entities by default
    iris: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    searches: list[Search] = field(default_factory=list)


@dataclass
class FrameQuery:
    """Frames by type, slots, child frames and the entity that owns them."""

    frame: Frame
    owner: EntityQuery | None = None
    limit: int | None = None
    offset: int = 0


@dataclass
class DocumentQuery:
    """Documents or their segments. ``scope``: all, segments, originals or summaries."""

    scope: str = "all"
    document_type: str | None = None
    method: str | None = None
    segment_type: str | None = None
    parent: str | None = None
    tokens: tuple[int | None, int | None] = (None, None)
    entity: EntityQuery = field(default_factory=EntityQuery)
    by_document: bool = False


@dataclass
class RelationQuery:
    relation_type: str | None = None
    direction: str = "out"  # out, in or both
    source: EntityQuery = field(default_factory=EntityQuery)
    destination: EntityQuery = field(default_factory=EntityQuery)
    exclude_self: bool = True


def literal(value) -> A.Term:
    if isinstance(value, bool):
        return A.Term(T.boolean(value))
    if isinstance(value, int):
        return A.Term(T.integer(value))
    if isinstance(value, float):
        return A.Term(T.literal(repr(value), T.XSD + "double"))
    text = str(value)
    return A.Term(T.iri(text)) if text.startswith(("urn:", "http:", "https:")) else A.Term(T.literal(text))


class Criteria:
    """Builds patterns; every helper variable is fresh. Edges and slots come from the store's derived
    tables where it has them, else from the quads of edge and slot nodes."""

    def __init__(self, derived=()):
        self.fresh, self.derived = count(), derived

    def var(self) -> A.Var:
        return A.Var(f".k{next(self.fresh)}")

    def triple(self, s, p: str, o) -> A.Triple:
        return A.Triple(s, A.Term(T.iri(p)), o)

    def linked(self, a, b):
        if "edges" in self.derived:
            return A.Derived("edges", {"source": a, "dest": b})
        edge = self.var()
        return A.BGP([self.triple(edge, EDGE_SOURCE, a), self.triple(edge, EDGE_DEST, b)])

    def filled(self, frame, slot_type: str, property, value):
        """A frame's slot of a type with a value; ``property`` None: of any value property."""
        if "slots" in self.derived:
            cells = {"frame": frame, "slot_type": A.Term(T.iri(slot_type)), "value": value}
            return A.Derived("slots", cells | ({"property": A.Term(T.iri(property))} if property else {}))
        slot, p = self.var(), self.var() if property is None else A.Term(T.iri(property))
        found = A.Join(self.linked(frame, slot), A.BGP([self.triple(slot, SLOT_TYPE, A.Term(T.iri(slot_type))), A.Triple(slot, p, value)]))
        return found if property else A.Filter(found, A.Call("IN", (p, *(A.Term(T.iri(x)) for x in VALUE_PROPERTIES.values()))))

    def with_frames(self, pattern, owner, frames: list[Frame]):
        for f in frames:
            body = self.frame(owner, f)
            pattern = A.Filter(pattern, A.Exists(body, f.negate))
        return pattern

    def frame(self, owner, f: Frame):
        node = self.var()
        return self.frame_at(A.Join(self.linked(owner, node), self.typed(node, f)), node, f)

    def typed(self, node, f: Frame) -> A.BGP:
        return A.BGP([self.triple(node, FRAME_TYPE, A.Term(T.iri(f.frame_type)))])

    def frame_at(self, body, node, f: Frame):
        for s in f.slots:
            body = self.slot(body, node, s)
        return self.with_frames(body, node, f.frames)

    def slot(self, body, frame, s: Slot):
        def valued(test=None, value=None):
            v = value or self.var()
            p = self.filled(frame, s.slot_type, s.property(), v)
            return p if test is None else A.Filter(p, test(v))

        values = s.value if isinstance(s.value, list) else [s.value]
        among = lambda v: A.Call("IN", (v, *map(literal, values)))
        match s.comparator:
            case "exists":
                return A.Filter(body, A.Exists(valued(), False))
            case "not_exists":
                return A.Filter(body, A.Exists(valued(), True))
            case "is_empty":
                return A.Filter(body, A.Exists(valued(lambda v: A.Call("!=", (A.Call("STR", (v,)), A.Term("S")))), True))
            case "contains":
                test = lambda v: A.Call("CONTAINS", (A.Call("LCASE", (A.Call("STR", (v,)),)), A.Term("S" + str(s.value).lower())))
                return A.Filter(body, A.Exists(valued(test), False))
            case "has" | "has_any":
                return A.Filter(body, A.Exists(valued(among), False))
            case "not_has" | "not_has_any":
                return A.Filter(body, A.Exists(valued(among), True))
            case "has_all":
                for x in values:
                    body = A.Filter(body, A.Exists(valued(lambda v, x=x: A.Call("=", (v, literal(x)))), False))
                return body
        return A.Filter(body, A.Exists(valued(lambda v: A.Call(SYMBOLS[s.comparator], (v, literal(s.value)))), False))

    def entity(self, q: EntityQuery, e: A.Var):
        pattern = A.BGP([self.triple(e, T.RDF_TYPE, A.Term(T.iri(q.kind or ENTITY)))])
        if q.entity_type:
            pattern.triples.append(self.triple(e, ENTITY_TYPE, A.Term(T.iri(q.entity_type))))
        for prop, comparator, value in [*q.properties, *([(NAME, "contains", q.name_contains)] if q.name_contains else [])]:
            v = self.var()
            body = A.BGP([self.triple(e, prop, v)])
            if comparator == "contains":
                body = A.Filter(body, A.Call("CONTAINS", (A.Call("LCASE", (A.Call("STR", (v,)),)), A.Term("S" + str(value).lower()))))
            elif comparator in SYMBOLS:
                body = A.Filter(body, A.Call(SYMBOLS[comparator], (v, literal(value))))
            pattern = A.Filter(pattern, A.Exists(body, comparator == "not_exists"))
        if q.iris:
            pattern = A.Join(A.Values([e.name], [[T.iri(x)] for x in q.iris]), pattern)
        if q.references:
            pattern = A.Filter(pattern, A.Exists(A.Join(A.Values([(v := self.var()).name], [[T.literal(x)] for x in q.references]), A.BGP([self.triple(e, REFERENCE, v)])), False))
        pattern = self.with_frames(pattern, e, q.frames)
        for s in q.searches:
            found = self.search(e, s)
            pattern = A.Filter(pattern, found if s.least is None else A.Call(">=", (found, literal(float(s.least)))))
        return pattern

    def search(self, e: A.Var, s: Search) -> A.Call:
        from ..functions.search import NS

        return A.Call("I" + NS + s.function, (e, *(literal(float(x)) if isinstance(x, int | float) else A.Term(T.literal(str(x))) for x in s.args)))


def iri_text(v: A.Var) -> A.Call:
    """The text of a variable that holds IRIs: a sort key without regard to what else a term can be."""
    return A.Call("STR", (v,))


def _run(engine: Engine, pattern, names: list[str]) -> DataFrame:
    s = engine.builder().build(pattern, engine.dataset(A.Query("select", pattern)))
    s = s.select(names)
    for n in names:
        s = s.with_rep(n, ("term", ""))
    return s.df.select(*(F.substr(F.col(column_name(n)), F.lit(2)).alias(n) for n in names))


def entities(engine: Engine, q: EntityQuery) -> DataFrame:
    """(entity) in pages; without a sort by IRI."""
    c, e = Criteria(engine.store.derived), A.Var("entity")
    pattern, keys = c.entity(q, e), []
    for s in q.sort:
        v = c.var()
        if s.search:
            keys.append((c.search(e, s.search), not s.descending))
            continue
        if s.property:
            side = A.BGP([c.triple(e, s.property, v)])
        else:
            frame = c.var()
            side = A.Join(A.Join(c.linked(e, frame), A.BGP([c.triple(frame, FRAME_TYPE, A.Term(T.iri(s.frame_type)))])), c.filled(frame, s.slot_type, None, v))
        # one key an entity, the smallest or largest of several
        best = A.Var(f".s{len(keys)}")
        side = A.Group(side, [("entity", e)], [(best.name, A.Aggregate("MAX" if s.descending else "MIN", v))])
        pattern = A.LeftJoin(pattern, side)
        keys.append((best, not s.descending))
    pattern = A.OrderBy(pattern, [*keys, (iri_text(e), True)])
    if q.limit is not None or q.offset:
        pattern = A.Slice(pattern, q.offset, q.limit)
    return _run(engine, pattern, ["entity"])


def total(engine: Engine, q: EntityQuery, mode: str = "exact", cap: int = 10_000) -> DataFrame:
    """(total, capped): exact, bounded by ``cap``, or none."""
    from dataclasses import replace

    rows = entities(engine, replace(q, sort=[], limit=None, offset=0))
    if mode == "none":
        return rows.limit(0).agg(F.lit(None).cast("long").alias("total"), F.lit(False).alias("capped"))
    if mode == "bounded":
        return rows.limit(cap + 1).agg(F.least(F.count("*"), F.lit(cap)).alias("total"), (F.count("*") > cap).alias("capped"))
    return rows.agg(F.count("*").alias("total"), F.lit(False).alias("capped"))


def relations(engine: Engine, q: RelationQuery) -> DataFrame:
    """(source, edge, destination, relation_type) of connected entities."""
    def one(forward: bool):
        c = Criteria(engine.store.derived)
        a, b, edge, kind = A.Var("source"), A.Var("destination"), A.Var("edge"), A.Var("relation_type")
        first, last = (a, b) if forward else (b, a)
        pattern = A.BGP([c.triple(edge, EDGE_SOURCE, first), c.triple(edge, EDGE_DEST, last), c.triple(edge, RELATION_TYPE, kind)])
        pattern = A.Join(A.Join(pattern, c.entity(q.source, a)), c.entity(q.destination, b))
        if q.relation_type:
            pattern = A.Filter(pattern, A.Call("=", (kind, A.Term(T.iri(q.relation_type)))))
        if q.exclude_self:
            pattern = A.Filter(pattern, A.Call("!=", (a, b)))
        return pattern

    pattern = one(q.direction != "in")
    if q.direction == "both":
        pattern = A.Union(pattern, one(False))
    return _run(engine, pattern, ["source", "edge", "destination", "relation_type"])


def relation_count(engine: Engine, q: RelationQuery) -> DataFrame:
    """(total): how many relations there are; one that matches in both directions counts once."""
    return relations(engine, q).agg(F.count_distinct("edge").alias("total"))


def frames(engine: Engine, q: FrameQuery) -> DataFrame:
    """(frame, entity) of the frames that meet the criteria, in pages by IRI; entity only with an owner."""
    c, f, e = Criteria(engine.store.derived), A.Var("frame"), A.Var("entity")
    pattern = c.frame_at(c.typed(f, q.frame), f, q.frame)
    names = ["frame"]
    if q.owner is not None:
        pattern, names = A.Join(A.Join(pattern, c.linked(e, f)), c.entity(q.owner, e)), ["frame", "entity"]
    pattern = A.OrderBy(pattern, [(iri_text(A.Var(n)), True) for n in names])
    if q.limit is not None or q.offset:
        pattern = A.Slice(pattern, q.offset, q.limit)
    return _run(engine, pattern, names)


def connected(engine: Engine, frame: Frame, source_slot: str, dest_slot: str, source: EntityQuery | None = None, destination: EntityQuery | None = None, exclude_self: bool = True) -> DataFrame:
    """(source, frame, destination): entities tied by a frame whose two slots name them."""
    c, f, a, b = Criteria(engine.store.derived), A.Var("frame"), A.Var("source"), A.Var("destination")
    pattern = c.frame_at(c.typed(f, frame), f, frame)
    for slot, end in ((source_slot, a), (dest_slot, b)):
        pattern = A.Join(pattern, c.filled(f, slot, SLOT_VALUE, end))
    for q, end in ((source, a), (destination, b)):
        if q is not None:
            pattern = A.Join(pattern, c.entity(q, end))
    if exclude_self:
        pattern = A.Filter(pattern, A.Call("!=", (a, b)))
    return _run(engine, pattern, ["source", "frame", "destination"])


def documents(engine: Engine, q: DocumentQuery) -> DataFrame:
    """(entity), or (document, segments) of the documents whose segments match, with ``by_document``."""
    from dataclasses import replace

    c, e, v = Criteria(engine.store.derived), A.Var("entity"), A.Var("parent")
    pattern = c.entity(replace(q.entity, kind=DOCUMENT), e)
    for p, value in ((DOCUMENT_TYPE, q.document_type), (SEGMENT_METHOD, q.method), (SEGMENT_TYPE, q.segment_type), (PARENT, q.parent)):
        if value:
            pattern = A.Join(pattern, A.BGP([c.triple(e, p, A.Term(T.iri(value)))]))
    having = lambda p, test=None: A.Exists(A.Filter(A.BGP([c.triple(e, p, x := c.var())]), test(x)) if test else A.BGP([c.triple(e, p, c.var())]), False)
    match q.scope:
        case "segments":
            pattern = A.Filter(pattern, having(SEGMENT_INDEX, lambda x: A.Call(">", (x, literal(0)))))
        case "summaries":
            pattern = A.Join(pattern, A.BGP([c.triple(e, SEGMENT_TYPE, A.Term(T.iri(SUMMARY_TYPE)))]))
        case "originals":
            pattern = A.Filter(pattern, A.Exists(A.BGP([c.triple(e, SEGMENT_TYPE, c.var())]), True))
        case "all":
            pass
        case other:
            raise ValueError(f"unknown scope {other}")
    for bound, symbol in zip(q.tokens, (">=", "<="), strict=True):
        if bound is not None:
            pattern = A.Filter(pattern, having(SEGMENT_TOKENS, lambda x, b=bound, s=symbol: A.Call(s, (x, literal(b)))))
    if not q.by_document:
        return _run(engine, A.OrderBy(pattern, [(iri_text(e), True)]), ["entity"])
    rows = _run(engine, A.Join(pattern, A.BGP([c.triple(e, PARENT, v)])), ["parent", "entity"])
    return rows.groupBy(F.col("parent").alias("document")).agg(F.count_distinct("entity").alias("segments"))


def run(engine: Engine, q) -> DataFrame:
    """Any of the query kinds."""
    kinds = {EntityQuery: entities, FrameQuery: frames, DocumentQuery: documents, RelationQuery: relations}
    return kinds[type(q)](engine, q)


def listing(engine: Engine, kind: str, name_contains: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(entity, name): objects of a type with their names, in pages by IRI, the name looked up for the page alone."""
    page = entities(engine, EntityQuery(kind=kind, name_contains=name_contains, limit=limit, offset=offset))
    names = engine.store.quads([T.iri(NAME)]).where(F.col("p") == T.iri(NAME)).select(F.substr("s", F.lit(2)).alias("entity"), "o")
    names = names.groupBy("entity").agg(F.min(F.substr("o", F.lit(2))).alias("name"))
    return page.join(names, "entity", "left")


def hierarchy(engine: Engine, root: str | None = None) -> DataFrame:
    """(parent, child) frames that edges tie, below a root frame or all."""
    c, a, b = Criteria(engine.store.derived), A.Var("parent"), A.Var("child")
    kinds = (A.BGP([c.triple(x, FRAME_TYPE, c.var())]) for x in (a, b))
    pairs = _run(engine, A.Distinct(A.Project(reduce(A.Join, kinds, c.linked(a, b)), ["parent", "child"])), ["parent", "child"])
    if root is None:
        return pairs
    pairs = cut(pairs)
    known = level = cut(pairs.where(F.col("parent") == root))
    while not level.isEmpty():
        below = level.select(F.col("child").alias("parent")).distinct()
        level = cut(pairs.join(below, "parent", "left_semi").join(known, ["parent", "child"], "left_anti"))
        known = cut(known.unionByName(level))
    return known


def shared_frames(engine: Engine, frame_type: str) -> DataFrame:
    """(a, frame, b): pairs of entities that meet in a frame."""
    c = Criteria(engine.store.derived)
    a, b, f = A.Var("a"), A.Var("b"), A.Var("frame")
    kind = A.BGP([c.triple(f, FRAME_TYPE, A.Term(T.iri(frame_type)))])
    pattern = A.Join(A.Join(c.linked(a, f), c.linked(b, f)), kind)
    return _run(engine, A.Filter(pattern, A.Call("<", (A.Call("STR", (a,)), A.Call("STR", (b,))))), ["a", "frame", "b"])


def entity_graph(quads: DataFrame, roots: DataFrame, grouping: str = KG + "hasKGGraphURI") -> DataFrame:
    """Quads of all objects whose grouping IRI is one of ``roots`` (column entity), for hydration."""
    members = quads.where(F.col("p") == T.iri(grouping)).join(roots.select(F.concat(F.lit("I"), "entity").alias("o")), "o", "left_semi").select("s")
    return quads.join(members.distinct(), "s", "left_semi")
