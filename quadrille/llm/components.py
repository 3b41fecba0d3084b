"""Connected components by edge contraction.

Each round every node points at its smallest neighbour if that is smaller than itself, pointers are
shortened, and edges are rewritten to the nodes pointed at; edges within a node vanish, so the edge
table shrinks round by round. All steps are grouped minima (combined before the shuffle) and joins,
with a stored table at the end of each round; nothing is collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

MAX_ROUNDS = 60
JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a long, b long); component is the smallest id reachable.

    Loops, repeated edges and either order of a pair are allowed; rows with a null end are ignored.
    No edges give no rows.
    """
    both = edges.where("a <> b")
    edge = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    label = None
    for _ in range(MAX_ROUNDS):
        ends = edge.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edge.select(F.col("b").alias("u"), F.col("a").alias("v")))
        parent = ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("p"))
        for _ in range(JUMPS):
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("id", F.col("q").alias("p"))
        parent = stored(parent, "parents")
        if label is None:
            grown = parent.select("id", F.col("p").alias("component"))
        else:
            step = parent.select(F.col("id").alias("component"), "p")
            grown = label.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        grown = stored(grown, "labels")
        pa, pb = parent.select(F.col("id").alias("a"), F.col("p").alias("x")), parent.select(F.col("id").alias("b"), F.col("p").alias("y"))
        left = edge.join(pa, "a").join(pb, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        rest = stored(left, "edges")
        for old in (edge, parent, label):
            if old is not None:
                discard(old)
        edge, label = rest, grown
        if edge.isEmpty():
            discard(edge)
            return label
    raise RuntimeError("components did not settle")
