"""Search functions as extension functions of the query language.

Each reads a side table of the engine (``indexes``: name -> table with a column ``s`` of canonical
subjects and ``vector``, ``text``, ``name`` or ``lat``/``lon``). The builder joins the side tables an
expression names to its subject variable before it compiles the expression, so a lookup is an equi-join
and the score a native column.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import algebra as A
from . import measures as M
from . import terms as T
from .expressions import extension
from .values import Val

#: Namespace of the functions; ``Engine(aliases=...)`` maps another one to it.
NS = "urn:quadrille:search#"
DEFAULTS = {"vector": "vectors", "text": "texts", "geo": "places", "name": "names"}
#: Vectors nearer than this count as candidates of a hybrid search without a text match.
HYBRID_DISTANCE = 0.6


@dataclass(frozen=True)
class Side:
    """A side table that an expression needs: its kind, index name and subject variable; a fuzzy one holds
    the scores of the candidates for a query."""

    kind: str
    index: str
    var: str
    query: tuple = ()

    def column(self, part: str | None = None) -> str:
        return f"_side_{self.kind}_{md5(f'{self.index} {self.var} {self.query}'.encode()).hexdigest()}_{part or self.kind}"

    def table(self, engine):
        kind = "name" if self.kind == "fuzzy" else self.kind
        found = engine.indexes[kind, self.index] if (kind, self.index) in engine.indexes else engine.indexes[self.index]
        if self.kind == "fuzzy":
            from .fuzzy import scored

            return scored(found, *self.query)
        return found

    def parts(self) -> list[str]:
        return ["lat", "lon"] if self.kind == "geo" else [self.kind]


def value_of(e):
    """Python value of a constant argument."""
    if isinstance(e, A.Term):
        _, text, _, datatype = T.parts(e.text)
        return float(text) if datatype in T.NUMERICS else text
    raise ValueError(f"a search function needs a constant, not {e!r}")


def _sides(name: str, args: tuple) -> list[Side]:
    var = args[0].name
    if name in ("vectorSimilarity", "vectorNearby"):
        return [Side("vector", value_of(args[2]) if len(args) > 2 else DEFAULTS["vector"], var)]
    if name in ("multiVectorSimilarity", "multiVectorNearby"):
        return [Side("vector", value_of(index), var) for _, index, _ in triples(args[1:])]
    if name == "textSearch":
        return [Side("text", value_of(args[2]) if len(args) > 2 else DEFAULTS["text"], var)]
    if name == "hybridSearch":
        return [Side("text", value_of(args[2]), var), Side("vector", value_of(args[2]), var)]
    if name == "trigramSimilarity":
        return [Side("name", DEFAULTS["name"], var)]
    if name == "fuzzyMatch":
        return [Side("fuzzy", DEFAULTS["name"], var, tuple(map(value_of, args[1:3])))]
    if name in ("geoDistance", "withinRadius", "withinBounds", "withinPolygon"):
        return [Side("geo", DEFAULTS["geo"], var)]
    return []


def sides_of(e) -> list[Side]:
    """Side tables that an expression's search functions read."""
    if isinstance(e, A.Call):
        own = _sides(e.name[1 + len(NS) :], e.args) if e.name.startswith("I" + NS) else []
        return own + [s for a in e.args for s in sides_of(a)]
    return []


def triples(args: tuple) -> list[tuple]:
    """(what, index, weight) groups, given as tuples or in a row."""
    if args and isinstance(args[0], A.Call) and args[0].name == "tuple":
        return [a.args for a in args]
    return [tuple(args[i : i + 3]) for i in range(0, len(args), 3)]


def _vector(c, text: str) -> list[float]:
    if c.engine.embed is None:
        raise ValueError("the engine has no embedder")
    return c.engine.embed(text)


def _similarity(side: Side, vector: list[float]) -> Column:
    return M.cosine(F.col(side.column()), [float(v) for v in vector])


@extension(NS + "vectorSimilarity")
def vector_similarity(c, args) -> Val:
    return Val("double", _similarity(_sides("vectorSimilarity", args)[0], _vector(c, value_of(args[1]))))


@extension(NS + "vectorNearby")
def vector_nearby(c, args) -> Val:
    return Val("double", _similarity(_sides("vectorNearby", args)[0], json.loads(value_of(args[1]))))


def _weighted(c, args, vector) -> Val:
    groups = triples(args[1:])
    total = sum(value_of(w) for _, _, w in groups)
    score = F.lit(0.0)
    for what, index, weight in groups:  # null, as soon as one index lacks the subject
        score = score + F.lit(value_of(weight) / total) * _similarity(Side("vector", value_of(index), args[0].name), vector(value_of(what)))
    return Val("double", score)


@extension(NS + "multiVectorSimilarity")
def multi_vector_similarity(c, args) -> Val:
    return _weighted(c, args, lambda text: _vector(c, text))


@extension(NS + "multiVectorNearby")
def multi_vector_nearby(c, args) -> Val:
    return _weighted(c, args, json.loads)


@extension(NS + "textSearch")
def text_search(c, args) -> Val:
    side = _sides("textSearch", args)[0]
    return Val("double", M.text_score(M.words_of(F.col(side.column())), value_of(args[1])))


@extension(NS + "hybridSearch")
def hybrid_search(c, args) -> Val:
    text, vector = _sides("hybridSearch", args)
    alpha = value_of(args[3])
    fts = M.text_score(M.words_of(F.col(text.column())), value_of(args[1]))
    near = _similarity(vector, _vector(c, value_of(args[1])))
    candidate = fts.isNotNull() | (1 - near < HYBRID_DISTANCE)
    return Val("double", F.when(candidate, (1 - alpha) * F.coalesce(fts, F.lit(0.0)) + alpha * F.coalesce(near, F.lit(0.0))))


@extension(NS + "trigramSimilarity")
def trigram(c, args) -> Val:
    side = _sides("trigramSimilarity", args)[0]
    return Val("double", M.trigram_similarity(F.col(side.column()), F.lit(value_of(args[1]))))


@extension(NS + "fuzzyMatch")
def fuzzy_match(c, args) -> Val:
    return Val("double", F.col(_sides("fuzzyMatch", args)[0].column()))


def _place(args) -> tuple[Column, Column]:
    side = Side("geo", DEFAULTS["geo"], args[0].name)
    return F.col(side.column("lat")), F.col(side.column("lon"))


@extension(NS + "geoDistance")
def geo_distance(c, args) -> Val:
    return Val("double", M.haversine(*_place(args), F.lit(value_of(args[1])), F.lit(value_of(args[2]))))


@extension(NS + "withinRadius")
def within_radius(c, args) -> Val:
    return Val("bool", M.within_radius(*_place(args), *map(value_of, args[1:4])))


@extension(NS + "withinBounds")
def within_bounds(c, args) -> Val:
    lat, lon = _place(args)
    a, b, x, y = map(value_of, args[1:5])
    return Val("bool", lat.between(a, x) & lon.between(b, y))


@extension(NS + "withinPolygon")
def within_polygon(c, args) -> Val:
    return Val("bool", M.within_polygon(*_place(args), M.polygon(value_of(args[1]))))


def fused(scores, score_columns: list[str], strategy: str = "weighted_sum", weights: list[float] | None = None, k: int = 60):
    """Fuse several score columns of one table: weighted_sum, relative_score (each scaled to its range,
    0.5 where the range is empty) or ranked (reciprocal ranks). Only rows with all scores remain."""
    from pyspark.sql import Window

    weights = weights or [1.0] * len(score_columns)
    shares = [w / sum(weights) for w in weights]
    rows = scores.dropna(subset=score_columns)
    if strategy == "weighted_sum":
        parts = [F.col(c) for c in score_columns]
    elif strategy == "relative_score":
        # two plain aggregates and a one-row join instead of an unpartitioned window
        bounds = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in score_columns for n, f in (("lo", F.min), ("hi", F.max))))
        rows = rows.crossJoin(F.broadcast(bounds))
        parts = [F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.5) for c in score_columns]
    elif strategy == "ranked":
        parts = []
        for c in score_columns:
            rows = ranked(rows, c, scores.columns[0], f"_rank_{c}")
            parts.append(1.0 / (k + F.col(f"_rank_{c}")))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    total = F.lit(0.0)
    for share, part in zip(shares, parts, strict=True):
        total = total + F.lit(share) * part
    return rows.withColumn("score", total).select(*scores.columns, "score")


def ranked(rows, score: str, key: str, out: str):
    """Ranks from 1 by falling score, ties by key: places within range partitions and the counts of those before."""
    from pyspark.sql import Window

    from ..operators.cut import cut

    # the ranges must not change between the two uses
    placed = cut(rows.repartitionByRange(F.desc(score), F.asc(key)).withColumn("_part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(score), F.asc(key)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return placed.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(out, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")
