"""Where triple patterns are answered: quads as they are, or typed tables seen as a graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import values as V
from ..functions.values import Val
from ..operators import solutions as S
from ..operators.solutions import Solutions, column_name
from ..plans import algebra as A

#: Name of the default graph in the g column.
DEFAULT_GRAPH = T.iri("urn:quadrille:default")
QUAD_SCHEMA = "s string, p string, o string, g string"


@dataclass(frozen=True)
class Dataset:
    """Graphs a pattern sees: ``default`` None is the union of all, ``named`` None every named one."""

    default: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None
    graph: object | None = None  # inside GRAPH: a Term or Var
    lock: tuple[str, ...] | None = None

    def condition(self, g: Column) -> Column:
        tests = []
        if self.lock is not None:
            tests.append(g.isin(*self.lock))
        if isinstance(self.graph, A.Term):
            tests.append(g == self.graph.text)
            if self.named is not None:
                tests.append(F.lit(self.graph.text in self.named))
        elif isinstance(self.graph, A.Var):
            tests.append(g != DEFAULT_GRAPH if self.named is None else g.isin(*self.named))
        elif self.default is not None:
            tests.append(g.isin(*self.default))
        return V.all_of(tests)


def bind_pattern(df: DataFrame, cells: list[tuple[object, Val]]) -> Solutions:
    """Filter by the constants, equate repeated variables and name the rest."""
    bound: dict[str, Val] = {}
    tests = []
    for want, have in cells:
        if isinstance(want, A.Term):
            tests.append(matches_constant(have, want.text))
        elif want.name in bound:
            tests.append(V.same_term(bound[want.name], have))
        else:
            bound[want.name] = have
            if have.kind != "term":
                tests.append(have.col.isNotNull())
    df = df.where(V.all_of(tests)) if tests else df
    cols = [v.col.alias(column_name(n)) for n, v in bound.items()]
    return Solutions(df.select(*cols) if cols else df.select(F.lit(1).alias("_unit")), {n: v.rep() for n, v in bound.items()})


def matches_constant(have: Val, term: str) -> Column:
    """Identity with a constant, on the native column where there is one."""
    kind, text, _, datatype = T.parts(term)
    if have.kind == "term":
        return have.col == term
    if have.kind == "iri":
        return (have.col.cast("string") == text.removeprefix(have.prefix)) & F.lit(kind == "U" and text.startswith(have.prefix)) if kind == "U" else F.lit(False)
    if kind != "L" or V.DATATYPES[have.kind] != datatype:
        return F.lit(False)
    want = V.constant(term)
    if want.kind == have.kind:
        return have.col == want.col
    return V.lex(have) == text


class Store:
    """Interface: ``bgp`` answers a basic graph pattern, ``edges`` a predicate's pairs."""

    spark: SparkSession
    #: Derived tables with canonical terms and a column g: edges (source, dest), slots (frame, slot_type, property, value).
    derived: dict[str, DataFrame] = {}

    def bgp(self, triples: list[A.Triple], data: Dataset) -> Solutions:
        raise NotImplementedError

    def quads(self, predicates: list[str] | None = None) -> DataFrame:
        """(s, p, o, g) as canonical terms, of the given predicates or all."""
        raise NotImplementedError

    def pattern(self, t: A.Triple, data: Dataset) -> Solutions:
        only = [t.p.text] if isinstance(t.p, A.Term) else None
        quads = self.quads(only)
        quads = quads.where(data.condition(F.col("g")))
        cells = [(t.s, Val("term", F.col("s"))), (t.p, Val("term", F.col("p"))), (t.o, Val("term", F.col("o")))]
        if isinstance(data.graph, A.Var):
            cells.append((data.graph, Val("term", F.col("g"))))
        return bind_pattern(quads, cells)

    def joined(self, parts: list[tuple[set[str], float, object]]) -> Solutions:
        """Join answers in an order that stays connected and begins with the most selective.

        parts: (variables, estimated rows, function that gives the Solutions).
        """
        left = list(parts)
        left.sort(key=lambda x: x[1])
        names, _, make = left.pop(0)
        out, seen = make(), set(names)
        while left:
            at = next((i for i, (n, _, _) in enumerate(left) if n & seen), 0)
            names, _, make = left.pop(at)
            out, seen = S.join(out, make()), seen | names
        return out


def triple_vars(t: A.Triple) -> set[str]:
    return {x.name for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}


class QuadStore(Store):
    """A set of quads. ``statistics`` (predicate -> count) steers join order where it is known; ``derived``
    are tables that queries over entities, frames and slots read in place of the quads."""

    def __init__(self, quads: DataFrame, statistics: dict[str, int] | None = None, graphs: frozenset[str] = frozenset(), derived: dict[str, DataFrame] | None = None):
        self.spark, self._quads, self.statistics, self.graphs = quads.sparkSession, quads, statistics or {}, graphs
        self.derived = derived or {}

    def quads(self, predicates: list[str] | None = None) -> DataFrame:
        return self._quads if predicates is None else self._quads.where(F.col("p").isin(*predicates))

    def estimate(self, t: A.Triple) -> float:
        base = float(self.statistics.get(t.p.text, 1e6)) if isinstance(t.p, A.Term) else 1e9
        return base * (1e-4 if isinstance(t.s, A.Term) else 1) * (1e-2 if isinstance(t.o, A.Term) else 1)

    def bgp(self, triples: list[A.Triple], data: Dataset) -> Solutions:
        if not triples:
            return S.unit(self.spark)
        graph = {data.graph.name} if isinstance(data.graph, A.Var) else set()
        return self.joined([(triple_vars(t) | graph, self.estimate(t), lambda t=t: self.pattern(t, data)) for t in triples])


@dataclass
class TableMap:
    """A table as a graph: a row is the subject <urn:NAME:KEY>, a column the predicate <urn:col:COLUMN>;
    ``refs`` maps foreign keys to the tables whose rows <urn:ref:COLUMN> points to."""

    name: str
    df: DataFrame
    keys: list[str]
    refs: dict[str, str] = field(default_factory=dict)

    def subject(self) -> Val:
        key = F.col(self.keys[0]) if len(self.keys) == 1 else F.concat_ws("-", *(F.col(k).cast("string") for k in self.keys))
        return Val("iri", key, f"urn:{self.name}:")

    def cell(self, predicate: str) -> Val | None:
        """Value of a predicate (an IRI as text), or None where the table has no such column."""
        if predicate == T.RDF_TYPE:
            return Val("iri", F.lit(self.name), "urn:table:")
        if predicate.startswith("urn:ref:") and (c := predicate[8:]) in self.refs:
            return Val("iri", F.col(c), f"urn:{self.refs[c]}:")
        c = predicate.removeprefix("urn:col:")
        if c == predicate or c not in self.df.columns:
            return None
        kind = NATIVE.get(self.df.schema[c].dataType.simpleString().split("(")[0])
        if kind is None:
            return None
        name, cast = kind
        return Val(name, F.col(c).cast(cast) if cast else F.col(c))

    def predicates(self) -> list[str]:
        return [T.RDF_TYPE, *(f"urn:ref:{c}" for c in self.refs), *(f"urn:col:{c}" for c in self.df.columns if self.cell(f"urn:col:{c}") is not None)]


# Value kinds of column types, with the type they are widened to.
NATIVE = {
    "tinyint": ("int", "bigint"),
    "smallint": ("int", "bigint"),
    "int": ("int", "bigint"),
    "bigint": ("int", None),
    "float": ("double", "double"),
    "double": ("double", None),
    "decimal": ("decimal", None),
    "string": ("string", None),
    "boolean": ("bool", None),
    "timestamp": ("dateTime", None),
    "timestamp_ntz": ("dateTime", "timestamp"),
    "date": ("dateTime", "timestamp"),
}


class TableStore(Store):
    """Tables queried as a graph without making quads of them.

    A star (patterns with one subject and constant predicates) is one scan of the table that has the
    columns; references join on the native keys. Other patterns go over the tables' cells as quads.
    """

    def __init__(self, spark: SparkSession, tables: list[TableMap]):
        self.spark, self.tables = spark, {t.name: t for t in tables}

    def bgp(self, triples: list[A.Triple], data: Dataset) -> Solutions:
        if not triples:
            return S.unit(self.spark)
        if data.graph is not None or data.default is not None or data.lock is not None:
            graph = {data.graph.name} if isinstance(data.graph, A.Var) else set()
            return self.joined([(triple_vars(t) | graph, 1.0, lambda t=t: self.pattern(t, data)) for t in triples])
        stars: dict[object, list[A.Triple]] = {}
        parts = []
        for t in triples:
            if isinstance(t.p, A.Term):
                stars.setdefault(t.s, []).append(t)
            else:
                parts.append((triple_vars(t), 1e9, lambda t=t: self.pattern(t, data)))
        for s, own in stars.items():
            names = set().union(*map(triple_vars, own))
            constants = sum(isinstance(t.o, A.Term) for t in own) + 4 * isinstance(s, A.Term)
            parts.append((names, 1e6 / 10**constants, lambda s=s, own=own: self.star(s, own)))
        return self.joined(parts)

    def star(self, s, triples: list[A.Triple]) -> Solutions:
        found = []
        for t in self.tables.values():
            cells = [(x.o, t.cell(T.parts(x.p.text)[1])) for x in triples]
            if all(v is not None for _, v in cells):
                tests = [v.col.isNotNull() for _, v in cells]
                found.append(bind_pattern(t.df.where(V.all_of(tests)), [(s, t.subject()), *cells]))
        if not found:
            return S.empty(self.spark, sorted(set().union(*map(triple_vars, triples))))
        return reduce(S.union, found)

    def quads(self, predicates: list[str] | None = None) -> DataFrame:
        wanted = None if predicates is None else {T.parts(p)[1] for p in predicates}
        branches = []
        for t in self.tables.values():
            names = [p for p in t.predicates() if wanted is None or p in wanted]
            if names:
                pairs = F.array(*(F.struct(F.lit(T.iri(p)).alias("p"), V.term(t.cell(p)).alias("o")) for p in names))
                branches.append(t.df.select(V.term(t.subject()).alias("s"), F.explode(pairs).alias("c")).select("s", "c.p", "c.o", F.lit(DEFAULT_GRAPH).alias("g")).where("o is not null"))
        if not branches:
            return self.spark.createDataFrame([], QUAD_SCHEMA)
        return reduce(DataFrame.unionAll, branches)

    def materialised(self) -> QuadStore:
        return QuadStore(self.quads())
