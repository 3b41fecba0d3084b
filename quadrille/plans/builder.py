"""Algebra to DataFrames: one method an operator; Catalyst plans the rest."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import values as V
from ..functions.expressions import Compiler
from ..functions.values import Val
from ..operators import solutions as S
from ..operators.paths import Paths
from ..operators.solutions import Solutions, column_name
from ..sources.store import Dataset, Store, bind_pattern
from . import algebra as A


class Builder:
    def __init__(self, store: Store, now: str, base: str = "", engine=None):
        self.store, self.now, self.base, self.engine = store, now, base, engine

    def with_sides(self, s: Solutions, *expressions) -> Solutions:
        """Join the side tables that search functions in the expressions read."""
        from ..functions.search import sides_of

        df = s.df
        for side in dict.fromkeys(x for e in expressions for x in sides_of(e)):
            if side.column(side.parts()[0]) in df.columns or side.var not in s.reps:
                continue
            table = side.table(self.engine)
            key = "_key_" + side.column()
            right = table.select(F.col("s").alias(key), *(F.col(p).alias(side.column(p)) for p in side.parts()))
            df = df.join(right, V.term(s.val(side.var)) == F.col(key), "left").drop(key)
        return Solutions(df, s.reps, s.maybe)

    def compiler(self, scope: dict[str, Val], flags: dict | None = None) -> Compiler:
        return Compiler(scope, self.now, self.base, flags, self.engine)

    def build(self, node, data: Dataset) -> Solutions:
        return getattr(self, "_" + type(node).__name__.lower())(node, data)

    def _bgp(self, n: A.BGP, data: Dataset) -> Solutions:
        return self.store.bgp(n.triples, data)

    def _derived(self, n: A.Derived, data: Dataset) -> Solutions:
        df = self.store.derived[n.table]
        df = df.where(data.condition(F.col("g")))
        cells = [(want, Val("term", F.col(c))) for c, want in n.cells.items()]
        if isinstance(data.graph, A.Var):
            cells.append((data.graph, Val("term", F.col("g"))))
        return bind_pattern(df, cells)

    def _pathpattern(self, n: A.PathPattern, data: Dataset) -> Solutions:
        start, end = (x.text if isinstance(x, A.Term) else None for x in (n.s, n.o))
        pairs = Paths(self.store, data).pairs(n.path, start, end)
        if isinstance(n.s, A.Var) and n.s == n.o:
            pairs = pairs.where("a = b")
        cols = {}
        for want, have in ((n.s, "a"), (n.o, "b"), *([(data.graph, "g")] if isinstance(data.graph, A.Var) else [])):
            if isinstance(want, A.Var):
                cols.setdefault(want.name, have)
        if not cols:
            return Solutions(pairs.limit(1).select(F.lit(1).alias("_unit")))
        return Solutions(pairs.select(*(F.col(c).alias(column_name(v)) for v, c in cols.items())), dict.fromkeys(cols, ("term", "")))

    def _join(self, n: A.Join, data: Dataset) -> Solutions:
        return S.join(self.build(n.left, data), self.build(n.right, data))

    def _leftjoin(self, n: A.LeftJoin, data: Dataset) -> Solutions:
        left, right = self.named(self.build(n.left, data), data), self.build(n.right, data)
        if n.condition is None:
            return S.left_join(left, right)
        left, right = self.with_sides(left, n.condition), self.with_sides(right, n.condition)
        if has_exists(n.condition):
            # the condition is decided on the joined rows; rows that fail keep the left side alone
            joined = self._filtered(S.join(left, right), n.condition, data)
            alone = S.semi_join(left, joined, negated=True)
            return S.union(joined, alone)
        return S.left_join(left, right, lambda scope: self.compiler(scope).condition(n.condition))

    def _union(self, n: A.Union, data: Dataset) -> Solutions:
        return S.union(self.named(self.build(n.left, data), data), self.named(self.build(n.right, data), data))

    def _minus(self, n: A.Minus, data: Dataset) -> Solutions:
        return S.semi_join(self.build(n.left, data), self.build(n.right, data), negated=True, both_bound=True)

    def _filter(self, n: A.Filter, data: Dataset) -> Solutions:
        return self._filtered(self.build(n.child, data), n.condition, data)

    def _filtered(self, s: Solutions, condition, data: Dataset) -> Solutions:
        """Conjuncts one by one; EXISTS at the top is a semi or anti join, deeper a flag column."""
        s = self.with_sides(s, condition)
        plain = []
        for c in conjuncts(condition):
            if not isinstance(c, A.Exists):
                plain.append(c)
            elif (held := self.held(c.pattern, s, data)) is not None:
                s = S.having_keys(s, *held, negated=c.negated)
            else:
                body, tests = self.exists_body(c.pattern, s, data)
                s = S.semi_join(s, body, c.negated, tests)
        s, flags, names = self.with_flags(s, plain, data)
        if plain:
            compiler = self.compiler(s.scope(), flags)
            s = s.filter(reduce(lambda x, y: x & y, (compiler.condition(c) for c in plain)))
        return Solutions(s.df.drop(*names), s.reps, s.maybe) if names else s

    def with_flags(self, s: Solutions, expressions: list, data: Dataset):
        """Flag columns for the EXISTS within expressions: solutions, flags of the compiler, column names."""
        flags, names = {}, []
        for e in (x for expression in expressions for x in exists_in(expression)):
            names.append(f"_flag{len(names)}")
            if (held := self.held(e.pattern, s, data)) is not None:
                s = S.flagged_keys(s, *held, flag=names[-1])
            else:
                body, tests = self.exists_body(e.pattern, s, data)
                s = S.flagged(s, body, names[-1], tests)
            flags[id(e)] = ~F.col(names[-1]) if e.negated else F.col(names[-1])
        return s, flags, names

    def held(self, pattern, outer: Solutions, data: Dataset) -> tuple[Solutions, list[str]] | None:
        """Distinct values of outer variables for which a body with EXISTS of its own has a solution.

        Needed where that inner EXISTS mentions variables which only the outer pattern binds: then no
        join of outer and body alone can tell. Where the body shares nothing with the outer pattern and
        the inner test is one NOT EXISTS, matches are counted against the body's rows (relational
        division); else the test is decided for the pairs of outer values and body solutions.
        """
        if not isinstance(pattern, A.Filter) or not has_exists(pattern.condition):
            return None
        inner = set(A.in_scope(pattern.child))
        far = (A.expression_vars(pattern.condition) - inner) & set(outer.reps)
        if not far:
            return None
        keys = [v for v in outer.reps if v in far or v in inner]
        own = outer.select(keys)
        own = Solutions(own.df.distinct(), own.reps, own.maybe)
        middle = self.build(pattern.child, data)
        e = pattern.condition
        if isinstance(e, A.Exists) and e.negated and not inner & set(outer.reps) and self.held(e.pattern, own, data) is None:
            body, tests = self.exists_body(e.pattern, S.together(own, middle), data)
            shared = [v for v in middle.reps if v in body.reps]
            if tests is None and shared and set(keys) <= set(body.reps) and not own.maybe and not middle.maybe & set(shared) and not body.maybe & {*shared, *keys}:
                return S.undivided(own, middle.select(shared), body.select([*keys, *shared])), keys
        found = self._filtered(S.join(own, middle), e, data).select(keys)
        return Solutions(found.df.distinct(), found.reps, found.maybe), keys

    def graphs(self, data: Dataset) -> Solutions:
        """The named graphs of the dataset, as values of the variable of GRAPH."""
        g = self.store.quads().where(data.condition(F.col("g"))).select(F.col("g").alias(column_name(data.graph.name))).distinct()
        return Solutions(g, {data.graph.name: ("term", "")})

    def named(self, s: Solutions, data: Dataset) -> Solutions:
        """Inside GRAPH ?g: solutions that bind ?g; those that do not hold in every named graph."""
        if not isinstance(data.graph, A.Var) or data.graph.name in s.reps:
            return s
        return S.join(self.graphs(data), s)

    def exists_body(self, pattern, outer: Solutions, data: Dataset):
        """The body without the filters that need outer variables, and these as a join condition."""
        tests = []
        while isinstance(pattern, A.Filter) and not has_exists(pattern.condition):
            inner = set(A.in_scope(pattern.child))
            if not (A.expression_vars(pattern.condition) - inner) & set(outer.reps):
                break
            tests.append(pattern.condition)
            pattern = pattern.child
        body = self.build(pattern, data)
        if not tests:
            return body, None
        return body, lambda scope: V.all_of([self.compiler(scope).condition(t) for t in tests])

    def _extend(self, n: A.Extend, data: Dataset) -> Solutions:
        s, flags, names = self.with_flags(self.with_sides(self.build(n.child, data), n.expr), [n.expr], data)
        v = V.settled(self.compiler(s.scope(), flags)(n.expr))
        df = s.df.withColumn(column_name(n.var), v.col).drop("_unit", *names)
        sure = isinstance(n.expr, A.Term) or (isinstance(n.expr, A.Var) and n.expr.name in s.reps and n.expr.name not in s.maybe)
        return Solutions(df, s.reps | {n.var: v.rep()}, s.maybe if sure else s.maybe | {n.var})

    def _graph(self, n: A.Graph, data: Dataset) -> Solutions:
        inside = replace(data, graph=n.name)
        return self.named(self.build(n.child, inside), inside)

    def _values(self, n: A.Values, data: Dataset) -> Solutions:
        schema = ", ".join(f"{column_name(v)} string" for v in n.names) or "_unit int"
        rows = [tuple(r) for r in n.rows] if n.names else [(1,) for _ in n.rows]
        df = self.store.spark.createDataFrame(rows, schema)
        maybe = {v for i, v in enumerate(n.names) if any(r[i] is None for r in n.rows)}
        return Solutions(df, dict.fromkeys(n.names, ("term", "")), maybe)

    def _group(self, n: A.Group, data: Dataset) -> Solutions:
        inputs = [*(e for _, e in n.keys), *(a.arg for _, a in n.aggregates if a.arg is not None)]
        s = self.named(self.build(n.child, data), data)
        s, flags, _ = self.with_flags(self.with_sides(s, *inputs), inputs, data)
        c = self.compiler(s.scope(), flags)
        by = n.keys
        if isinstance(data.graph, A.Var) and data.graph.name not in dict(by):
            by = [*by, (data.graph.name, data.graph)]  # each named graph has groups of its own
        keys = [(name, V.settled(c(e))) for name, e in by]
        made = []
        for i, (name, a) in enumerate(n.aggregates):
            v = None if a.arg is None else V.settled(c(a.arg))
            if v is not None and v.kind == "term" and not isinstance(a.arg, A.Var):
                s = Solutions(s.df.withColumn(f"_arg{i}", v.col), s.reps, s.maybe)  # computed once, used in several places
                v = Val("term", F.col(f"_arg{i}"))
            made.append((name, *aggregate(a, v, s)))
        grouped = s.df.groupBy(*(v.col.alias(column_name(k)) for k, v in keys)) if keys else s.df.groupBy()
        df = grouped.agg(*(col.alias(column_name(k)) for k, col, _ in made)) if made else grouped.agg(F.lit(1).alias("_unit")).drop("_unit" if keys else "")
        reps = {k: v.rep() for k, v in keys} | {k: rep for k, _, rep in made}
        sure = {k for k, e in by if isinstance(e, A.Var) and e.name in s.reps and e.name not in s.maybe}
        sure |= {name for name, a in n.aggregates if a.name == "COUNT"}
        return Solutions(df, reps, set(reps) - sure)

    def _project(self, n: A.Project, data: Dataset) -> Solutions:
        s = self.named(self.build(n.child, data), data)
        inside = [data.graph.name] if isinstance(data.graph, A.Var) and data.graph.name not in n.names else []
        return s.select([*n.names, *inside])

    def _distinct(self, n: A.Distinct, data: Dataset) -> Solutions:
        s = self.witnessed(n.child, data) or self.build(n.child, data)
        return Solutions(s.df.distinct(), s.reps, s.maybe)

    def witnessed(self, n, data: Dataset) -> Solutions | None:
        """DISTINCT of variables that one side of a join binds: the other side is only asked whether it has a
        match, so a semi join takes the join's place and rows are not multiplied before they are made distinct."""
        if not isinstance(n, A.Project) or isinstance(data.graph, A.Var):
            return None
        parts = split(n.child, set(n.names))
        if parts is None:
            return None
        left, right = (self.build(p, data) for p in parts)
        if set(n.names) & left.maybe or not set(left.reps) & set(right.reps):
            return None
        return S.semi_join(left, right).select(n.names)

    def _orderby(self, n: A.OrderBy, data: Dataset) -> Solutions:
        s = self.build(n.child, data)
        by = [e for e, _ in n.keys]
        s, flags, names = self.with_flags(self.with_sides(s, *by), by, data)
        c = self.compiler(s.scope(), flags)
        keys = []
        for e, up in n.keys:
            for k in V.order_keys(c(e)):
                keys.append(k.asc_nulls_first() if up else k.desc_nulls_last())
        return Solutions(s.df.orderBy(*keys).drop(*names), s.reps, s.maybe)

    def _slice(self, n: A.Slice, data: Dataset) -> Solutions:
        s = self.build(n.child, data)
        df, inner = s.df, n.child
        while isinstance(inner, A.Project | A.Distinct):
            inner = inner.child
        if len(s.reps) == 1 and not isinstance(inner, A.OrderBy):
            df = df.orderBy(column_name(next(iter(s.reps))))  # stable pages
        if n.offset:
            df = df.offset(n.offset)
        if n.limit is not None:
            df = df.limit(n.limit)
        return Solutions(df, s.reps, s.maybe)


def split(node, names: set[str]) -> tuple | None:
    """(pattern that binds all names, pattern that is joined with it), with filters on the side they read."""
    tests = []
    if isinstance(node, A.Filter) and not has_exists(node.condition):
        tests, node = conjuncts(node.condition), node.child
    if isinstance(node, A.Join):
        sides = [(node.left, node.right), (node.right, node.left)]
    elif isinstance(node, A.BGP):
        stars: dict = {}
        for t in node.triples:
            stars.setdefault(t.s, set()).update(x.name for x in (t.s, t.p, t.o) if isinstance(x, A.Var))
        own, open_ = set(), set(names)
        # few stars that bind the names, those of subjects among them first
        for s in sorted(stars, key=lambda s: (not (isinstance(s, A.Var) and s.name in names), -len(stars[s] & names), str(s))):
            if open_ & stars[s]:
                own.add(s)
                open_ -= stars[s]
        keep = [t for t in node.triples if t.s in own]
        rest = [t for t in node.triples if t.s not in own]
        if not rest or not connected(keep) or not connected(rest):
            return None
        sides = [(A.BGP(keep), A.BGP(rest))]
    else:
        return None
    for left, right in sides:
        a, b = set(A.in_scope(left)), set(A.in_scope(right))
        if not names <= a or not a & b:
            continue
        mine, others = [t for t in tests if A.expression_vars(t) <= a], [t for t in tests if not A.expression_vars(t) <= a]
        if all(A.expression_vars(t) <= b for t in others):
            return reduce(A.Filter, mine, left), reduce(A.Filter, others, right)
    return None


def connected(triples: list) -> bool:
    """Whether shared variables tie all triples together."""
    groups: list[set[str]] = []
    for t in triples:
        own = {x.name for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}
        met = [g for g in groups if g & own]
        groups = [g for g in groups if not g & own] + [own.union(*met)]
    return len(groups) <= 1


def conjuncts(e) -> list:
    return [*conjuncts(e.args[0]), *conjuncts(e.args[1])] if isinstance(e, A.Call) and e.name == "&&" else [e]


def exists_in(e) -> list:
    if isinstance(e, A.Exists):
        return [e]
    return [x for a in e.args for x in exists_in(a)] if isinstance(e, A.Call) else []


def has_exists(e) -> bool:
    return bool(exists_in(e))


def _quotient(total, n):
    """total / n as a decimal(38,18)."""
    whole = F.try_divide(total.try_cast("decimal(38,18)"), n.cast("decimal(10,0)"))
    return F.coalesce(whole.try_cast("decimal(38,18)"), F.try_divide(total.cast("double"), n.cast("double")).try_cast("decimal(38,18)"))


def aggregate(a: A.Aggregate, v: Val | None, s: Solutions):
    """(Column, representation) of an aggregate. SUM and AVG are unbound if any value is no number."""
    if a.name == "COUNT":
        if v is None:
            every = F.struct(*(F.col(column_name(x)) for x in s.reps)) if s.reps else F.lit(1)
            return (F.count_distinct(every) if a.distinct else F.count(F.lit(1))), ("int", "")
        return (F.count_distinct(v.col) if a.distinct else F.count(v.col)), ("int", "")
    native = v.kind in V.NUMBER_KINDS
    if a.name in ("SUM", "AVG"):
        pick = (F.sum_distinct if a.distinct else F.try_sum) if a.name == "SUM" else (lambda c: F.sum_distinct(c) / F.count_distinct(c)) if a.distinct else F.avg
        n = v.col if native else V.num(v)
        whole = F.count(F.lit(1)) == F.count(n)
        if native:
            kind = v.kind if a.name == "SUM" or v.kind == "double" else "decimal"
            n = n.cast("decimal(38,10)") if kind == "decimal" else n
            zero = F.lit(0).cast({"int": "bigint", "double": "double"}.get(kind, "decimal(38,18)"))
            out = pick(n)
            out = out.try_cast("decimal(38,18)") if kind == "decimal" else out
            return F.when(F.count(F.lit(1)) == 0, zero).when(whole, out), (kind, "")
        ranked = F.max(V.rank(v)) if a.name == "SUM" else F.greatest(F.max(V.rank(v)), F.lit(1))
        # integers and decimals are summed exactly as long as all values and the sum fit
        precise = V.exact(v)
        add, fits = F.sum_distinct if a.distinct else F.try_sum, F.count(precise) == F.count(n)
        integer, total = add(precise.cast("decimal(38,0)")), add(precise)
        if a.name == "AVG":
            many = (F.count_distinct if a.distinct else F.count)(precise)
            integer, total = None, F.when(F.max(V.rank(v)) == 0, _quotient(integer, many)).otherwise(_quotient(total, many))
        text = V.number_text(pick(n), ranked, F.when(fits, total), None if integer is None else F.when(fits, integer))
        return F.when(F.count(F.lit(1)) == 0, F.lit(T.integer(0))).when(whole, text), ("term", "")
    if a.name in ("MIN", "MAX"):
        if v.kind != "term" and v.kind != "iri":
            return (F.min if a.name == "MIN" else F.max)(v.col), v.rep()
        by = F.min_by if a.name == "MIN" else F.max_by
        return by(v.col, F.when(v.col.isNotNull(), V.order_struct(v))), v.rep()
    if a.name == "SAMPLE":
        return F.max(v.col), v.rep()
    if a.name == "GROUP_CONCAT":
        text = V.lex(v)
        values = F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text))
        return F.array_join(values, a.separator), ("string", "")
    raise ValueError(f"no aggregate {a.name}")
