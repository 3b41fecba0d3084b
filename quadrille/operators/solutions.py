"""Solution sequences: a DataFrame with a column for each variable, and joins of two of them.

Variables keep the representation of what bound them (see :mod:`quadrille.functions.values`), so two
tables that bind the same key join on the native column. ``maybe`` lists variables that can be unbound;
as long as none is shared, a join is a plain equi-join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val


def column_name(var: str) -> str:
    return "v_" + re.sub(r"[^A-Za-z0-9_]", lambda m: f"__{ord(m.group()):x}_", var)


@dataclass
class Solutions:
    df: DataFrame
    reps: dict[str, tuple[str, str]] = field(default_factory=dict)  # variable -> (kind, prefix)
    maybe: set[str] = field(default_factory=set)

    def val(self, var: str) -> Val:
        kind, prefix = self.reps[var]
        return Val(kind, F.col(column_name(var)), prefix)

    def scope(self) -> dict[str, Val]:
        return {v: self.val(v) for v in self.reps}

    def with_rep(self, var: str, rep: tuple[str, str]) -> Solutions:
        """The variable as a canonical term, if it is not in the representation asked for."""
        if self.reps[var] == rep:
            return self
        c = column_name(var)
        return Solutions(self.df.withColumn(c, V.term(self.val(var))), self.reps | {var: ("term", "")}, self.maybe)

    def select(self, names: list[str]) -> Solutions:
        """Keep the names; one that is not bound here becomes an unbound variable."""
        cols = [F.col(column_name(n)) if n in self.reps else F.lit(None).cast("string").alias(column_name(n)) for n in names]
        reps = {n: self.reps.get(n, ("term", "")) for n in names}
        return Solutions(self.df.select(*cols) if cols else self.df.select(F.lit(1).alias("_unit")), reps, {n for n in names if n in self.maybe or n not in self.reps})

    def filter(self, condition: Column) -> Solutions:
        return Solutions(self.df.where(condition), self.reps, self.maybe)


def unit(spark: SparkSession) -> Solutions:
    """One solution that binds nothing."""
    return Solutions(spark.range(1).select(F.lit(1).alias("_unit")))


def empty(spark: SparkSession, names: list[str]) -> Solutions:
    return unit(spark).filter(F.lit(False)).select(names)


def harmonised(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions]:
    """Shared variables in the same representation on both sides."""
    for v in [v for v in a.reps if v in b.reps and a.reps[v] != b.reps[v]]:
        a, b = a.with_rep(v, ("term", "")), b.with_rep(v, ("term", ""))
    return a, b


def _renamed(s: Solutions, shared: list[str]) -> DataFrame:
    """The right side of a join: shared variables get other column names, units vanish."""
    df = s.df.drop("_unit")
    return df.withColumnsRenamed({column_name(v): "r_" + column_name(v) for v in shared})


def _matches(a: Solutions, b: Solutions, shared: list[str]) -> tuple[Column, list[str]]:
    """Compatibility of the two sides, and the shared variables that may be unbound on one."""
    loose = [v for v in shared if v in a.maybe or v in b.maybe]
    parts = []
    for v in shared:
        left, right = F.col(column_name(v)), F.col("r_" + column_name(v))
        same = left == right
        if v in a.maybe:
            same = left.isNull() | same
        if v in b.maybe:
            same = right.isNull() | same
        parts.append(same)
    return V.all_of(parts), loose


def _finish(a: Solutions, b: Solutions, joined: DataFrame, shared: list[str], outer: bool) -> Solutions:
    cols = []
    for v in a.reps:
        c = column_name(v)
        both = v in shared and v in a.maybe
        cols.append((F.coalesce(F.col(c), F.col("r_" + c)) if both else F.col(c)).alias(c))
    cols += [F.col(column_name(v)) for v in b.reps if v not in a.reps]
    if outer:
        maybe = a.maybe | {v for v in b.reps if v not in a.reps}
    else:
        maybe = {v for v in a.maybe | b.maybe if not ((v in a.reps and v not in a.maybe) or (v in b.reps and v not in b.maybe))}
    reps = a.reps | {v: r for v, r in b.reps.items() if v not in a.reps}
    return Solutions(joined.select(*cols) if cols else joined.select(F.lit(1).alias("_unit")), reps, maybe)


def unsure_key(a: Solutions, b: Solutions, shared: list[str]) -> str | None:
    """A shared variable to split a join on: there is none if some shared variable is bound for sure."""
    loose = [v for v in shared if v in a.maybe or v in b.maybe]
    return loose[0] if loose and len(loose) == len(shared) else None


def sure(s: Solutions, v: str) -> Solutions:
    """The solutions that bind the variable; an equi-join can use it."""
    return Solutions(s.df.where(F.col(column_name(v)).isNotNull()), s.reps, s.maybe - {v}) if v in s.maybe else s


def free(s: Solutions, v: str) -> Solutions:
    """The solutions that do not bind the variable, without it."""
    df = s.df.where(F.col(column_name(v)).isNull()).drop(column_name(v))
    reps = {k: r for k, r in s.reps.items() if k != v}
    return Solutions(df if reps else df.withColumn("_unit", F.lit(1)), reps, s.maybe - {v})


def again(s: Solutions, v: str, rep: tuple[str, str], like: Solutions) -> Solutions:
    """Solutions without the variable, which gets back as an unbound one of the same type as in ``like``."""
    c = column_name(v)
    return Solutions(s.df.drop("_unit").withColumn(c, F.lit(None).cast(like.df.schema[c].dataType)), s.reps | {v: rep}, s.maybe | {v})


def join(a: Solutions, b: Solutions) -> Solutions:
    """Inner join of compatible solutions."""
    a, b = harmonised(a, b)
    shared = [v for v in a.reps if v in b.reps]
    if not b.reps and "_unit" in b.df.columns and not shared and b.df.columns == ["_unit"]:
        return Solutions(a.df.crossJoin(b.df.drop("_unit")) if a.reps else a.df.drop("_unit").crossJoin(b.df), a.reps, a.maybe)
    if v := unsure_key(a, b, shared):
        parts = [join(sure(a, v), sure(b, v))]
        if v in a.maybe:
            parts.append(join(free(a, v), b))
        if v in b.maybe:
            parts.append(join(sure(a, v), free(b, v)))
        return reduce(union, parts)
    condition, _ = _matches(a, b, shared)
    right = _renamed(b, shared)
    joined = a.df.join(right, condition, "inner") if shared else a.df.crossJoin(right)
    return _finish(a, b, joined, shared, False)


def left_join(a: Solutions, b: Solutions, condition=None) -> Solutions:
    """Left outer join; ``condition`` gets the merged scope and gives a Column."""
    a, b = harmonised(a, b)
    shared = [v for v in a.reps if v in b.reps]
    if unsure_key(a, b, shared):
        met = join(a, b)
        if condition is not None:
            met = met.filter(condition(met.scope()))
        return union(met, semi_join(a, b, negated=True, condition=condition))
    on, _ = _matches(a, b, shared)
    if condition is not None:
        on = on & condition(merged_scope(a, b, shared))
    right = _renamed(b, shared)
    if not right.columns:
        right = b.df.withColumnRenamed("_unit", "r__unit")
    return _finish(a, b, a.df.join(right, on, "left"), shared, True)


def merged_scope(a: Solutions, b: Solutions, shared: list[str]) -> dict[str, Val]:
    scope = {v: b.val(v) for v in b.reps if v not in a.reps} | a.scope()
    for v in shared:
        if v in a.maybe:
            kind, prefix = a.reps[v]
            scope[v] = Val(kind, F.coalesce(F.col(column_name(v)), F.col("r_" + column_name(v))), prefix)
    return scope


def semi_join(a: Solutions, b: Solutions, negated: bool = False, condition=None, both_bound: bool = False) -> Solutions:
    """EXISTS and NOT EXISTS; with ``both_bound`` MINUS, which also asks for a variable bound on both sides."""
    a, b = harmonised(a, b)
    shared = [v for v in a.reps if v in b.reps]
    if both_bound and not shared:
        return a if negated else a.filter(F.lit(False))
    if v := unsure_key(a, b, shared):
        rest = {"condition": condition, "both_bound": both_bound}
        # bound on both sides, which is all that MINUS asks for
        bound = {"condition": condition, "both_bound": False}
        left, gone = sure(a, v), free(a, v)
        if negated:
            out = semi_join(left, sure(b, v), True, **bound)
            out = semi_join(out, free(b, v), True, **rest) if v in b.maybe else out
        else:
            out = semi_join(left, sure(b, v), False, **bound)
            if v in b.maybe:
                out = union(out, semi_join(semi_join(left, sure(b, v), True, **bound), free(b, v), False, **rest))
        if v in a.maybe:
            # the variable is unbound here, so in a condition it is what ``b`` binds
            out = union(out, again(semi_join(gone, b, negated, **rest), v, a.reps[v], a))
        return Solutions(out.df.select(*a.df.columns), a.reps, a.maybe)
    on, loose = _matches(a, b, shared)
    if both_bound and len(loose) == len(shared):
        some = F.lit(False)
        for v in shared:
            some = some | (F.col(column_name(v)).isNotNull() & F.col("r_" + column_name(v)).isNotNull())
        on = on & some
    if condition is not None:
        on = on & condition(merged_scope(a, b, shared))
        right = _renamed(b, shared)
    else:
        keys = Solutions(b.df.select(*(column_name(v) for v in shared)) if shared else b.df.select(F.lit(1).alias("_unit")).limit(1), {v: b.reps[v] for v in shared}, b.maybe & set(shared))
        right = _renamed(keys, shared) if shared else keys.df.withColumnRenamed("_unit", "r__unit")
    if not right.columns:
        right = b.df.select(F.lit(1).alias("r__unit"))
    return Solutions(a.df.join(right, on, "left_anti" if negated else "left_semi"), a.reps, a.maybe)


def flagged(a: Solutions, b: Solutions, flag: str, condition=None) -> Solutions:
    """``a`` with a boolean column that tells whether a compatible solution of ``b`` exists."""
    a, b = harmonised(a, b)
    key = "_row"
    rows = Solutions(a.df.withColumn(key, F.monotonically_increasing_id()), a.reps, a.maybe)
    shared = [v for v in a.reps if v in b.reps]
    if condition is None and shared and not any(v in a.maybe or v in b.maybe for v in shared):
        keys = b.df.select(*(F.col(column_name(v)).alias("r_" + column_name(v)) for v in shared)).distinct().withColumn("_hit", F.lit(True))
        on, _ = _matches(a, b, shared)
        out = a.df.join(keys, on, "left").withColumn(flag, F.coalesce("_hit", F.lit(False)))
        return Solutions(out.drop("_hit", *("r_" + column_name(v) for v in shared)), a.reps, a.maybe)
    from .cut import cut

    rows = Solutions(cut(rows.df), a.reps, a.maybe)  # row numbers must not change between the two uses
    hits = semi_join(rows, b, condition=condition).df.select(F.col(key).alias("_hit"))
    out = rows.df.join(hits, F.col(key) == F.col("_hit"), "left").withColumn(flag, F.col("_hit").isNotNull())
    return Solutions(out.drop("_hit", key), a.reps, a.maybe)


def together(a: Solutions, b: Solutions) -> Solutions:
    """What is bound in either, without rows: the scope of a pattern below both."""
    return Solutions(a.df, b.reps | a.reps, a.maybe | b.maybe)


def _on_keys(a: Solutions, found: Solutions, keys: list[str]) -> tuple[Solutions, DataFrame, Column]:
    """``a``, the keys under other names, and their identity; unbound equals unbound."""
    a, found = harmonised(a, found)
    names = [column_name(v) for v in keys]
    return a, found.df.select(*(F.col(c).alias("k_" + c) for c in names)), V.all_of([F.col(c).eqNullSafe(F.col("k_" + c)) for c in names])


def having_keys(a: Solutions, found: Solutions, keys: list[str], negated: bool = False) -> Solutions:
    """The solutions whose values of ``keys`` are among those found, or are not."""
    a, right, on = _on_keys(a, found, keys)
    return Solutions(a.df.join(right, on, "left_anti" if negated else "left_semi"), a.reps, a.maybe)


def flagged_keys(a: Solutions, found: Solutions, keys: list[str], flag: str) -> Solutions:
    """``a`` with a boolean column that tells whether its values of ``keys`` are among those found."""
    a, right, on = _on_keys(a, found, keys)
    out = a.df.join(right.withColumn("_hit", F.lit(True)), on, "left").withColumn(flag, F.coalesce("_hit", F.lit(False)))
    return Solutions(out.drop("_hit", *right.columns), a.reps, a.maybe)


def undivided(keys: Solutions, middle: Solutions, body: Solutions) -> Solutions:
    """Keys for which some row of ``middle`` has no (key, row) in ``body``: fewer matches than rows.

    All variables are bound; ``middle`` has the variables of ``body`` that are not keys.
    """
    middle, body = harmonised(middle, body)
    keys, body = harmonised(keys, body)
    own, rest = ([column_name(v) for v in s.reps] for s in (keys, middle))
    rows = middle.df.distinct()
    met = body.df.distinct().join(rows, rest, "left_semi").groupBy(*own).agg(F.count("*").alias("_met"))
    every = rows.agg(F.count("*").alias("_rows"))  # one row
    out = keys.df.join(met, own, "left").crossJoin(F.broadcast(every)).where(F.coalesce("_met", F.lit(0)) < F.col("_rows"))
    return Solutions(out.select(*own), keys.reps, keys.maybe)


def union(a: Solutions, b: Solutions) -> Solutions:
    """Bag union; variables of one side only are unbound on the other."""
    a, b = harmonised(a, b)
    left, right = a.df.drop("_unit"), b.df.drop("_unit")
    reps = b.reps | a.reps
    if not reps:
        return Solutions(a.df.select(F.lit(1).alias("_unit")).unionAll(b.df.select(F.lit(1).alias("_unit"))))
    if not a.reps:
        left = a.df.select(*(F.lit(None).cast(b.df.schema[column_name(v)].dataType).alias(column_name(v)) for v in b.reps))
    if not b.reps:
        right = b.df.select(*(F.lit(None).cast(a.df.schema[column_name(v)].dataType).alias(column_name(v)) for v in a.reps))
    maybe = a.maybe | b.maybe | {v for v in reps if v not in a.reps or v not in b.reps}
    return Solutions(left.unionByName(right, allowMissingColumns=True), reps, maybe)
