"""Derived tables, statistics, segmentation and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import derived as D
from ..operators.registry import canonical, topological_levels
from ..sources.documents import markdown, segmented
from ..sources.star_schema import star_store
from ..sources.store import DEFAULT_GRAPH
from ..streaming.rollup import hours_of, merged, rollup, slowest

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def kg_quads(spark, sf_dir):
    """Orders as frames between customers and their segments, with edges and typed slots."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    c = lambda prefix, col: F.concat(F.lit("I" + prefix), F.col(col).cast("string"))
    frame, customer, segment = c("urn:frame:", "o_orderkey"), c("urn:customer:", "o_custkey"), c("urn:segment:", "c_mktsegment")
    i = lambda x: F.lit(T.iri(x))

    def triples():
        for tag, kind, value in (("a", D.SOURCE_SLOT, customer), ("b", D.DEST_SLOT, segment)):
            edge, slot = c(f"urn:edge:{tag}", "o_orderkey"), c(f"urn:slot:{tag}", "o_orderkey")
            yield edge, i(D.EDGE_SOURCE), frame
            yield edge, i(D.EDGE_DEST), slot
            yield slot, i(D.SLOT_TYPE), i(kind)
            yield slot, i(D.SLOT_VALUE), value

    rows = F.array(*(F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in triples()))
    return orders.select(F.explode(rows).alias("q")).select("q.*", F.lit(DEFAULT_GRAPH).alias("g"))


@query("edge_table", "select 'Iurn:edge:' || t || o_orderkey as edge, 'Iurn:frame:' || o_orderkey as source, 'Iurn:slot:' || t || o_orderkey as dest, 'Iurn:quadrille:default' as g from orders, (values ('a'), ('b')) v(t)")
def edge_table(spark, sf_dir):
    return D.edges(kg_quads(spark, sf_dir))


@query("frame_entity_table", "select 'Iurn:frame:' || o_orderkey as frame, 'Iurn:quadrille:default' as g, 'Iurn:customer:' || o_custkey as source_entity, 'Iurn:segment:' || c_mktsegment as dest_entity from orders join customer on o_custkey = c_custkey")
def frame_entity_table(spark, sf_dir):
    return D.frame_entities(kg_quads(spark, sf_dir))


@query("predicate_statistics", "select 'Iurn:col:n_name' as predicate, count(*) as quads from nation union all select 'Iurn:col:n_nationkey', count(*) from nation union all select 'Iurn:col:n_regionkey', count(*) from nation union all select 'Iurn:ref:n_regionkey', count(*) from nation union all select 'Ihttp://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) from nation")
def predicate_statistics(spark, sf_dir):
    return D.predicate_stats(star_store(spark, sf_dir, ["nation"]).quads())


@query("pair_statistics_whole", "select 'Iurn:ref:c_nationkey' as predicate, 'Iurn:nation:' || c_nationkey as object, count(*) as quads from customer group by c_nationkey")
def pair_statistics_whole(spark, sf_dir):
    return D.pair_stats(star_store(spark, sf_dir, ["customer"]).quads(["Iurn:ref:c_nationkey"]))


@query(
    "edge_fan_out",
    """with d as (select o_orderpriority as kind, o_custkey as n, count(*) as d from orders group by 1, 2), e as (select o_orderpriority as kind, o_orderstatus as n, count(*) as d from orders group by 1, 2)
    select kind, avg(d) as avg_degree, quantile_disc(d, 0.99) as p99_degree, max(d) as max_degree, count(*) as nodes, 'out' as direction from d group by 1
    union all select kind, avg(d), quantile_disc(d, 0.99), max(d), count(*), 'in' from e group by 1""",
)
def edge_fan_out(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("dest"))
    return D.fan_out(pairs, ["kind"])


@query("derived_drift", "select 'Iurn:edge:' || t || o_orderkey as edge, 'missing' as state from orders, (values ('a'), ('b')) v(t) where o_orderkey % 10 = 0")
def derived_drift(spark, sf_dir):
    quads = kg_quads(spark, sf_dir)
    kept = D.edges(quads).where("cast(regexp_extract(edge, '([0-9]+)$', 1) as bigint) % 10 <> 0")
    return D.drift(kept, D.edges(quads), ["edge"])


@query("same_as_canonical", "select n_nationkey as entity, 0 as canonical from nation where n_nationkey > 0")
def same_as_canonical(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return canonical(n.where("n_nationkey > 0").selectExpr("n_nationkey as source", "n_nationkey - 1 as target", "false as retracted"))


@query("dag_levels", "select 'n' || n_nationkey as node, 0 as level from nation union all select 'r' || r_regionkey, case when r_regionkey in (select n_regionkey from nation) then 1 else 0 end from region where r_regionkey in (select n_regionkey from nation)")
def dag_levels(spark, sf_dir):
    return topological_levels(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('n', n_nationkey) as source", "concat('r', n_regionkey) as dest"))


@query("metrics_rollup", "select date_trunc('hour', ts) as bucket, event_type, count(*) as requests, round(sum(value), 4) as total, max(value) as most from events group by 1, 2")
def metrics_rollup(spark, sf_dir):
    """Minutes first, then hours, with the odd events arriving late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    early, late = (rollup(events.where(F.col("event_id") % 2 == k), every="1 minute") for k in (0, 1))
    return hours_of(merged(early, late)).withColumn("total", F.round("total", 4))


@query("slow_log", "select event_id, value from events order by value desc, event_id limit 20")
def slow_log(spark, sf_dir):
    return slowest(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "value")


@query("document_segments")
def document_segments(spark, sf_dir):
    return segmented(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@query("page_markdown")
def page_markdown(spark, sf_dir):
    return markdown(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")
