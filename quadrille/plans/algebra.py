"""Algebra of graph patterns, queries and updates, and the expressions within them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    """A constant in the canonical form of :mod:`quadrille.functions.terms`."""

    text: str


@dataclass(frozen=True)
class Call:
    """An expression node: operator or function name with arguments."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None  # None: *
    distinct: bool = False
    separator: str = " "


# property paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    path: object
    low: int
    high: int | None  # None: unbounded


@dataclass(frozen=True)
class NotIn:
    forward: tuple
    inverse: tuple


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


# patterns
@dataclass
class BGP:
    triples: list


@dataclass
class Derived:
    """Rows of a derived table of the store; columns without a cell are dropped."""

    table: str
    cells: dict  # column -> Term or Var


@dataclass
class PathPattern:
    s: object
    path: object
    o: object


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: object | None = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    child: object
    condition: object


@dataclass
class Extend:
    child: object
    var: str
    expr: object


@dataclass
class Graph:
    name: object
    child: object


@dataclass
class Values:
    names: list
    rows: list


@dataclass
class Group:
    child: object
    keys: list  # (name, expression)
    aggregates: list  # (name, Aggregate)


@dataclass
class Project:
    child: object
    names: list


@dataclass
class Distinct:
    child: object


@dataclass
class OrderBy:
    child: object
    keys: list  # (expression, ascending)


@dataclass
class Slice:
    child: object
    offset: int
    limit: int | None


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    pattern: object
    names: list | None = None
    template: list = field(default_factory=list)
    targets: list = field(default_factory=list)
    from_graphs: list = field(default_factory=list)
    from_named: list = field(default_factory=list)


@dataclass
class Update:
    """kind: insert_data, delete_data, modify, clear, create, copy, move, add, load."""

    kind: str
    insert: list = field(default_factory=list)  # quads (s, p, o, g)
    delete: list = field(default_factory=list)
    pattern: object | None = None
    using: list = field(default_factory=list)
    using_named: list = field(default_factory=list)
    within: str | None = None  # WITH: the default graph, unless USING says otherwise
    target: object | None = None
    source: object | None = None
    silent: bool = False


def in_scope(node) -> list[str]:
    """Variables a pattern can bind, in order of appearance; helpers that blank nodes made are left out."""
    out: list[str] = []

    def add(*names):
        out.extend(n for n in names if n not in out)

    def term(t):
        if isinstance(t, Var):
            add(t.name)

    def walk(n):
        match n:
            case BGP(triples):
                for t in triples:
                    term(t.s), term(t.p), term(t.o)
            case PathPattern(s, _, o):
                term(s), term(o)
            case Derived(_, cells):
                for x in cells.values():
                    term(x)
            case Join(a, b) | LeftJoin(a, b) | Union(a, b):
                walk(a), walk(b)
            case Minus(a, _) | Filter(a, _) | Distinct(a) | OrderBy(a, _) | Slice(a, _, _):
                walk(a)
            case Extend(a, v, _):
                walk(a), add(v)
            case Graph(g, a):
                term(g), walk(a)
            case Values(names, _) | Project(_, names):
                add(*names)
            case Group(_, keys, aggregates):
                add(*(k for k, _ in keys), *(k for k, _ in aggregates))

    walk(node)
    return [n for n in out if not n.startswith(("_:", "."))]


def expression_vars(e) -> set[str]:
    match e:
        case Var(name):
            return {name}
        case Call(_, args):
            return set().union(*map(expression_vars, args)) if args else set()
        case Aggregate(_, arg):
            return expression_vars(arg) if arg is not None else set()
        case Exists(pattern):
            return set(in_scope(pattern)) | pattern_filter_vars(pattern)
    return set()


def pattern_filter_vars(node) -> set[str]:
    """Variables that filters within a pattern mention."""
    match node:
        case Filter(child, condition):
            return expression_vars(condition) | pattern_filter_vars(child)
        case Join(a, b) | Union(a, b) | Minus(a, b):
            return pattern_filter_vars(a) | pattern_filter_vars(b)
        case LeftJoin(a, b, c):
            return pattern_filter_vars(a) | pattern_filter_vars(b) | (expression_vars(c) if c else set())
        case Extend(a, _, e):
            return pattern_filter_vars(a) | expression_vars(e)
        case Graph(_, a):
            return pattern_filter_vars(a)
    return set()
