"""Property paths as pair tables.

A path becomes a table (a, b) and, inside GRAPH ?g, the graph both ends lie in. Closures are computed by
frontier: new pairs are the last round's pairs joined with a step, less those known, until none are
new; a bound end seeds the frontier, so only what it reaches is expanded. Each round is checkpointed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans import algebra as A
from .cut import cut

#: Rounds after which a closure is given up with an error.
MAX_ROUNDS = 1000


class Paths:
    def __init__(self, store, data):
        self.store, self.data = store, data
        self.keys = ["g"] if isinstance(data.graph, A.Var) else []

    def step(self, iri: str) -> DataFrame:
        q = self.store.quads([T.iri(iri)]).where(self.data.condition(F.col("g"))).where(F.col("p") == T.iri(iri))
        return q.select(F.col("s").alias("a"), F.col("o").alias("b"), *self.keys)

    def quads(self) -> DataFrame:
        return self.store.quads().where(self.data.condition(F.col("g")))

    def nodes(self) -> DataFrame:
        q = self.quads()
        return q.select(F.col("s").alias("n"), *self.keys).unionAll(q.select(F.col("o").alias("n"), *self.keys)).distinct()

    def identity(self, ends: list[str]) -> DataFrame:
        """(n, n) over the nodes of the data and the constants at the path's ends."""
        if ends:
            spark = self.store.spark
            own = spark.createDataFrame([(e,) for e in dict.fromkeys(ends)], "n string")
            if self.keys:
                own = own.crossJoin(self.quads().select("g").distinct())
            return own.select(F.col("n").alias("a"), F.col("n").alias("b"), *self.keys)
        return self.nodes().select(F.col("n").alias("a"), F.col("n").alias("b"), *self.keys)

    def swap(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *self.keys)

    def follow(self, first: DataFrame, second: DataFrame) -> DataFrame:
        left = first.select("a", F.col("b").alias("m"), *self.keys)
        right = second.select(F.col("a").alias("m"), "b", *self.keys)
        return left.join(right, ["m", *self.keys]).select("a", "b", *self.keys)

    def pairs(self, path, start: str | None = None, end: str | None = None) -> DataFrame:
        """Pairs of the path; a constant end restricts them."""
        out = self._pairs(path, start, end)
        if start is not None:
            out = out.where(F.col("a") == start)
        return out.where(F.col("b") == end) if end is not None else out

    def _pairs(self, path, start: str | None, end: str | None) -> DataFrame:
        match path:
            case A.Link(iri):
                return self.step(iri)
            case A.Inverse(inner):
                return self.swap(self.pairs(inner, end, start))
            case A.Seq(parts):
                found = [self.pairs(p, start if i == 0 else None, end if i == len(parts) - 1 else None) for i, p in enumerate(parts)]
                return reduce(self.follow, found)
            case A.Alt(parts):
                return reduce(DataFrame.unionAll, (self.pairs(p, start, end) for p in parts))
            case A.NotIn(forward, inverse):
                q = self.quads()
                out = []
                if forward or not inverse:
                    out.append(q.where(~F.col("p").isin(*map(T.iri, forward))) if forward else q)
                    out[-1] = out[-1].select(F.col("s").alias("a"), F.col("o").alias("b"), *self.keys)
                if inverse:
                    out.append(q.where(~F.col("p").isin(*map(T.iri, inverse))).select(F.col("o").alias("a"), F.col("s").alias("b"), *self.keys))
                return reduce(DataFrame.unionAll, out)
            case A.Repeat(inner, low, high):
                return self.repeated(inner, low, high, start, end)
        raise ValueError(f"no path: {path!r}")

    def repeated(self, inner, low: int, high: int | None, start: str | None, end: str | None) -> DataFrame:
        ends = [e for e in (start, end) if e is not None]
        if (low, high) == (0, 1):
            return self.identity(ends).unionByName(self.pairs(inner, start, end)).distinct()
        step = self.pairs(inner)
        if high is None and low <= 1:
            out = self.closure(step, start, end)
            return out if low == 1 else self.identity(ends).unionByName(out).distinct()
        base = reduce(self.follow, [step] * max(low, 1))
        if high is None:
            return base.unionByName(self.follow(base, self.closure(step, None, end))).distinct()
        if high == 0:
            return self.identity(ends)
        out = self.identity(ends).unionByName(base) if low == 0 else base
        power = base
        for _ in range(high - max(low, 1)):
            power = self.follow(power, step)
            out = out.unionByName(power)
        return out

    def closure(self, step: DataFrame, start: str | None, end: str | None) -> DataFrame:
        if start is None and end is not None:
            return self.swap(self.closure(self.swap(step), end, None))
        step = cut(step.distinct())
        frontier = step.where(F.col("a") == start) if start is not None else step
        known = frontier = cut(frontier)
        for _ in range(MAX_ROUNDS):
            new = self.follow(frontier, step).distinct().join(known, ["a", "b", *self.keys], "left_anti")
            frontier = cut(new)
            if frontier.isEmpty():
                return known
            known = cut(known.unionByName(frontier))
        raise RuntimeError(f"a path needs more than {MAX_ROUNDS} rounds")
