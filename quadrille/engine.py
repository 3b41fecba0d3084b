"""The query engine: SPARQL over a store."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import search as _search  # noqa: F401  registers the search functions
from .functions import terms as T
from .functions import values as V
from .operators.solutions import Solutions, column_name
from .plans import algebra as A
from .plans.builder import Builder
from .plans.parser import parse_query
from .sources.store import QUAD_SCHEMA, Dataset, QuadStore, Store

parsed = lru_cache(maxsize=256)(lambda text, prefixes, aliases: parse_query(text, dict(prefixes), dict(aliases)))


class Engine:
    """Runs queries against a store. ``prefixes`` are known to all of them; ``lock`` restricts every scan
    to the given graphs; ``indexes`` hold the side tables of the search functions; ``aliases`` map IRI
    prefixes in queries to others, such as another namespace of the search functions to the one here."""

    def __init__(self, store: Store, prefixes: dict[str, str] | None = None, lock: list[str] | None = None, indexes: dict | None = None, embed=None, aliases: dict[str, str] | None = None):
        self.store, self.prefixes, self.lock, self.indexes, self.embed, self.aliases = store, dict(prefixes or {}), lock, indexes or {}, embed, dict(aliases or {})

    @property
    def spark(self):
        return self.store.spark

    def builder(self) -> Builder:
        return Builder(self.store, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), engine=self)

    def dataset(self, q: A.Query) -> Dataset:
        default = tuple(map(T.iri, q.from_graphs)) if q.from_graphs or q.from_named else None
        named = tuple(map(T.iri, q.from_named)) if q.from_graphs or q.from_named else None
        return Dataset(default, named, None, tuple(map(T.iri, self.lock)) if self.lock is not None else None)

    def parse(self, text: str) -> A.Query:
        return parsed(text, tuple(sorted(self.prefixes.items())), tuple(self.aliases.items()))

    def solutions(self, text: str) -> Solutions:
        q = self.parse(text)
        return self.builder().build(q.pattern, self.dataset(q))

    def query(self, text: str, as_terms: bool = False) -> DataFrame:
        """SELECT: a column for each variable, native where its type is known, else the lexical form, or
        structs (kind, text, lang, datatype) with ``as_terms``. ASK: one row ``ask``. CONSTRUCT and
        DESCRIBE: triples (s, p, o) as canonical terms."""
        q = self.parse(text)
        builder, data = self.builder(), self.dataset(q)
        if q.form == "describe":
            return self.describe(q, builder, data)
        s = builder.build(q.pattern, data)
        if q.form == "ask":
            return s.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.form == "construct":
            return construct(q.template, s)
        names = q.names if q.names is not None else A.in_scope(q.pattern)
        s = s.select(names)
        return s.df.select(*((term_struct(s.val(n)) if as_terms else plain(s.val(n))).alias(n) for n in names)) if names else s.df

    def describe(self, q: A.Query, builder: Builder, data: Dataset) -> DataFrame:
        constants = [t.text for t in q.targets if isinstance(t, A.Term)]
        parts = [self.spark.createDataFrame([(c,) for c in constants], "s string")] if constants else []
        names = [t.name for t in q.targets if isinstance(t, A.Var)]
        if names:
            s = builder.build(q.pattern, data).select(names)
            parts += [s.df.select(V.term(s.val(n)).alias("s")).where(F.left("s", F.lit(1)).isin("I", "B")) for n in names]
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string")
        targets = reduce(DataFrame.unionAll, parts).distinct()
        quads = self.store.quads().where(data.condition(F.col("g")))
        return quads.join(targets, "s", "left_semi").select("s", "p", "o").distinct()


def plain(v: V.Val) -> Column:
    return v.col if v.kind not in ("term", "iri") else V.lex(v)


def term_struct(v: V.Val) -> Column:
    lang = V.lang(v)
    made = F.struct(
        F.when(V.kind_is(v, "I"), "U").when(V.kind_is(v, "B"), "B").otherwise("L").alias("kind"), V.lex(v).alias("text"), F.when(lang != "", lang).alias("lang"), V.datatype(v).alias("datatype")
    )
    return F.when(v.col.isNotNull(), made)


def instantiate(template: list, s: Solutions, graph: bool) -> DataFrame | None:
    """Template quads for every solution; those with unbound or illegal positions are left out."""
    df = s.df
    labels = sorted({x.name for t in template for x in t if isinstance(x, A.Var) and x.name.startswith("_:")})
    cols = {n: V.term(s.val(n)) for n in s.reps}
    if labels:
        from .operators.cut import cut

        df = cut(df.withColumn("_row", F.uuid()))  # a label stands for one fresh node a solution
        cols |= {n: F.concat(F.lit("B"), F.md5(F.concat(F.col("_row"), F.lit(n)))) for n in labels}

    def cell(x) -> Column:
        if isinstance(x, A.Term):
            return F.lit(x.text)
        return cols.get(x.name, F.lit(None).cast("string"))

    rows = []
    for t in template:
        one = [cell(x).alias(n) for x, n in zip(t[:3], "spo", strict=True)]
        if graph:
            one.append((F.lit("Iurn:quadrille:default") if t[3] is None else cell(t[3])).alias("g"))
        rows.append(F.struct(*one))
    if not rows:
        return None
    out = df.select(F.explode(F.array(*rows)).alias("q")).select("q.*")
    legal = F.left("s", F.lit(1)).isin("I", "B") & (F.left("p", F.lit(1)) == "I") & F.col("o").isNotNull()
    return out.where(legal & (F.left("g", F.lit(1)).isin("I", "B") if graph else F.lit(True)))


def construct(template: list, s: Solutions) -> DataFrame:
    out = instantiate(template, s, False)
    return s.df.sparkSession.createDataFrame([], "s string, p string, o string") if out is None else out.distinct()


__all__ = ["QUAD_SCHEMA", "Engine", "QuadStore", "column_name"]
