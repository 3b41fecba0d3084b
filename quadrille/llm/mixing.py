"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. Its whole
part is taken as it is; the fraction is rounded dependently: two fractional documents are paired and
words are moved from one to the other, in the direction drawn, until one of the two is integral, so
that the words taken so far never change and every document keeps its expectation. The pairing runs
as a reduction tree: documents are dealt to small chunks by hash, a fold pairs within a chunk and
leaves at most one fractional document, and these residuals are chunked again, level by level, until
one is left for each source, which is rounded by itself. A source's taken words so differ from its
target by less than one document.

Draws are hashes of the two documents and the level, so reruns agree whatever the partitioning.
Defined results: a null text has size 0 and is never taken; a null source is a source, last in the
order; rows that repeat id, source and size share one decision; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, stored

# Weights of the sources in code point order, repeating; the mix's part of all words;
# the most copies of a source's words.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Expected documents in a chunk of the tree.
CHUNK = 100
NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table with source and size.

    Targets are weight * level, capped at MOST * source size; the level is where they sum to SHARE of
    all words. It is found over the sources ordered by the level at which each meets its cap: with the
    first k capped, the rest share what is left, and the first k whose level lies below the next
    source's is right. The running sums go over one row a source, range by range.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"), F.lit(1).alias("one"))
    ranked = running(by_source, [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("before_one") % len(WEIGHTS) + 1).cast("int"))
    capped = ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * MOST).alias("cap"))
    stepped = running(capped.withColumn("at", F.col("cap") / F.col("w")), [F.col("at").asc(), F.col("source").asc_nulls_last()], ["cap", "w"])
    every = stepped.agg((F.sum("source_size") * SHARE).alias("all_words"), F.sum("w").alias("all_weights"))  # one row
    stepped = stepped.crossJoin(F.broadcast(every)).withColumn("level", (F.col("all_words") - F.col("before_cap")) / (F.col("all_weights") - F.col("before_w")))
    first = F.when(F.col("level") <= F.col("at"), F.struct("at", F.coalesce("source", F.lit("")), "level"))
    found = stepped.agg(F.min(first)["level"].alias("found"))  # one row
    target = F.least("cap", F.col("w") * F.coalesce("found", F.lit(0.0))).alias("target")
    return stepped.crossJoin(F.broadcast(found)).select("source", "source_size", target)


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with before_x for each x in ``sums``: its sum over the rows before, in the order given.

    Rows are dealt to ranges, which are stored so that they stay as they are, summed within each, and the
    totals of the ranges before are added: a row for each range is all that comes together.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_no").agg(*(F.sum(x).alias(f"sum_{x}") for x in sums))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range_no", *(F.coalesce(F.sum(f"sum_{x}").over(earlier), F.lit(0)).alias(f"past_{x}") for x in sums))
    joined = dealt.join(F.broadcast(totals), "range_no")
    out = joined.select(*rows.columns, *((F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"past_{x}")).alias(f"before_{x}") for x in sums))
    return stored(out, "running")


def _draw(level: int, first: Column, second: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), first, second), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(level: int, items: Column) -> Column:
    """Pivotal rounding along an array of (h, p, w): struct(h, p, w of the residual, out: resolved)."""
    kind = "struct<h:bigint,p:double,w:double,out:array<struct<h:bigint,x:int>>>"

    def resolved(h: Column, x: Column) -> Column:
        return F.struct(h.alias("h"), x.cast("int").alias("x"))

    def pair(acc: Column, item: Column) -> Column:
        # words that can move to the residual (up) and from it (down)
        up = F.least((1 - acc["p"]) * acc["w"], item["p"] * item["w"])
        down = F.least(acc["p"] * acc["w"], (1 - item["p"]) * item["w"])
        rises = _draw(level, acc["h"], item["h"]) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        step = F.struct(rises.alias("rises"), (acc["p"] + moved / acc["w"]).alias("a"), (item["p"] - moved / item["w"]).alias("b"))
        # a one-element transform binds the step once for what follows
        return F.transform(F.array(step), lambda s: settle(acc, item, s))[0]

    def settle(acc: Column, item: Column, s: Column) -> Column:
        goal_a, goal_b = F.when(s["rises"], 1.0).otherwise(0.0), F.when(s["rises"], 0.0).otherwise(1.0)
        first = F.abs(s["a"] - goal_a) <= F.abs(s["b"] - goal_b)  # which of the two is integral now
        return F.struct(
            F.when(first, item["h"]).otherwise(acc["h"]).alias("h"),
            F.when(first, s["b"]).otherwise(s["a"]).alias("p"),
            F.when(first, item["w"]).otherwise(acc["w"]).alias("w"),
            F.array_append(acc["out"], F.when(first, resolved(acc["h"], goal_a)).otherwise(resolved(item["h"], goal_b))).alias("out"),
        ).cast(kind)

    head = items[0]
    start = F.struct(head["h"].alias("h"), head["p"].alias("p"), head["w"].alias("w"), F.array().cast("array<struct<h:bigint,x:int>>").alias("out")).cast(kind)
    return F.aggregate(F.slice(items, 2, 1 << 30), start, pair)


def rounded(units: DataFrame) -> DataFrame:
    """(source, h, x): x is 0 or 1 for every unit (source, h, p, w) with 0 < p < 1 and w > 0."""
    resolved, level = None, 0
    while True:
        count = units.groupBy("source").agg(F.count("*").alias("units"))
        most = count.agg(F.max("units")).first()[0]
        if not most:
            break
        chunks = F.ceil(F.col("units") / CHUNK)
        dealt = units.join(count.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(level)), chunks))
        folded = dealt.groupBy("source", "chunk").agg(_fold(level, F.array_sort(F.collect_list(F.struct("h", "p", "w")))).alias("f"))
        folded = stored(folded.select("source", "f"), "rounds")
        out = folded.select("source", F.explode("f.out").alias("r")).select("source", "r.h", "r.x")
        units = folded.select("source", "f.h", "f.p", "f.w")
        if most <= CHUNK:
            last = units.select("source", "h", (_draw(-1, F.col("h"), F.lit(0)) < F.col("p")).cast("int").alias("x"))
            out, units = out.unionByName(last), units.limit(0)
        resolved = out if resolved is None else resolved.unionByName(out)
        level += 1
        if most <= CHUNK:
            break
    if resolved is None:
        return units.select("source", "h", F.lit(0).alias("x"))
    return resolved


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, source_col, size, source_size, target, copies, taken."""
    sizes = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    sizes = stored(sizes, "sizes")
    goal = stored(targets(sizes).withColumnRenamed("source", "s"), "targets")
    rows = sizes.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate + NEAR)).withColumn("p", rate - F.col("whole"))
    rows = rows.withColumn("h", F.xxhash64("id", "source", "size"))
    units = rows.where((F.col("p") > NEAR) & (F.col("size") > 0)).groupBy("source", "h").agg(F.first("p").alias("p"), F.sum("size").cast("double").alias("w"))
    extra = rounded(units).select("h", "x").groupBy("h").agg(F.max("x").alias("x"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("x", F.lit(0))).otherwise(F.lit(0)).cast("long")
    done = rows.join(extra, "h", "left").withColumn("copies", copies)
    return done.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
