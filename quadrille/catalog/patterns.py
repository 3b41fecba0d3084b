"""Graph patterns, joins, aggregation, ordering, set operations and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.star_schema import PREFIXES, quad_engine, star_engine, star_store
from ..sources.store import QuadStore

QUERIES, ORACLES = {}, {}


def sparql(name: str, query: str, oracle: str, tables: list[str] | None = None, quads: list[str] | None = None):
    def run(spark, sf_dir):
        engine = quad_engine(spark, sf_dir, quads) if quads else star_engine(spark, sf_dir, tables)
        return engine.query(query)

    QUERIES[name], ORACLES[name] = run, oracle


sparql(
    "nation_customers",
    "SELECT ?name (COUNT(?c) AS ?n) WHERE { ?c ref:c_nationkey ?k . ?k col:n_name ?name } GROUP BY ?name",
    "select n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1",
)
sparql(
    "pricing_summary",
    """SELECT ?flag ?status (SUM(?q) AS ?sum_qty) (ROUND(SUM(?p)) AS ?sum_price) (ROUND(SUM(?p * (1 - ?d))) AS ?sum_disc) (COUNT(*) AS ?n)
    WHERE { ?l col:l_returnflag ?flag ; col:l_linestatus ?status ; col:l_quantity ?q ; col:l_extendedprice ?p ; col:l_discount ?d ; col:l_shipdate ?s
      FILTER(?s <= "1998-09-02T00:00:00"^^xsd:dateTime) } GROUP BY ?flag ?status""",
    """select l_returnflag as flag, l_linestatus as status, sum(l_quantity) as sum_qty, floor(sum(l_extendedprice) + 0.5) as sum_price,
      floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) as sum_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
    ["lineitem"],
)
sparql(
    "region_revenue",
    """SELECT ?region (ROUND(SUM(?p * (1 - ?d))) AS ?revenue) WHERE {
      ?l ref:l_orderkey ?o ; ref:l_suppkey ?s ; col:l_extendedprice ?p ; col:l_discount ?d . ?o ref:o_custkey ?c . ?c ref:c_nationkey ?k .
      ?s ref:s_nationkey ?k . ?k ref:n_regionkey ?r . ?r col:r_name ?region } GROUP BY ?region""",
    """select r_name as region, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) as revenue from lineitem join orders on l_orderkey = o_orderkey
      join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey
      join region on n_regionkey = r_regionkey group by 1""",
)
sparql(
    "scan_constants",
    'SELECT ?o ?total WHERE { ?o col:o_orderstatus "F" ; col:o_orderpriority "1-URGENT" ; col:o_totalprice ?total FILTER(?total > 100000) }',
    "select 'urn:orders:' || o_orderkey as o, o_totalprice as total from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice > 100000",
)
sparql("ask_large_order", "ASK { ?o col:o_totalprice ?t FILTER(?t > 1000000000) }", "select count(*) > 0 as ask from (select 1 from orders where o_totalprice > 1000000000 limit 1)")
sparql(
    "constant_only_pattern",
    "SELECT (COUNT(*) AS ?n) WHERE { <urn:nation:0> ref:n_regionkey <urn:region:0> }",
    "select count(*) as n from nation where n_nationkey = 0 and n_regionkey = 0",
)
sparql(
    "repeated_variable",
    "SELECT ?o WHERE { ?l ref:l_orderkey ?o ; col:l_partkey ?k ; col:l_suppkey ?k }",
    "select 'urn:orders:' || l_orderkey as o from lineitem where l_partkey = l_suppkey",
)
sparql("empty_pattern", "SELECT (1 + 2 AS ?three) WHERE { }", "select 3 as three")
sparql("empty_relation", "SELECT ?x WHERE { ?x <urn:no:such> ?y }", "select '' as x where false")
sparql(
    "optional_orders_whole",
    "SELECT ?name ?o WHERE { ?c col:c_name ?name OPTIONAL { ?o ref:o_custkey ?c ; col:o_totalprice ?t FILTER(?t > 150000) } }",
    "select c_name as name, 'urn:orders:' || o_orderkey as o from customer left join orders on o_custkey = c_custkey and o_totalprice > 150000",
    ["customer", "orders"],
)
sparql(
    "optional_nested",
    "SELECT ?n ?r ?s WHERE { ?k col:n_name ?n OPTIONAL { ?k ref:n_regionkey ?g . ?g col:r_name ?r FILTER(?r != \"ASIA\") OPTIONAL { ?x ref:s_nationkey ?k ; col:s_name ?s } } }",
    """select n_name as n, r_name as r, s_name as s from nation left join (select n_nationkey as k, r_name, s_name from nation join region on n_regionkey = r_regionkey and r_name <> 'ASIA'
      left join supplier on s_nationkey = n_nationkey) on k = n_nationkey""",
)
sparql(
    "join_over_optional",
    "SELECT ?n ?c WHERE { { SELECT ?k ?n WHERE { ?k col:n_name ?n } } OPTIONAL { ?s ref:s_nationkey ?k ; col:s_acctbal ?b FILTER(?b > 3000) } ?c ref:c_nationkey ?k FILTER(!BOUND(?s)) }",
    "select n_name as n, 'urn:customer:' || c_custkey as c from nation join customer on c_nationkey = n_nationkey where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 3000)",
)
sparql(
    "not_exists",
    "SELECT ?c WHERE { ?c col:c_mktsegment \"BUILDING\" FILTER NOT EXISTS { ?o ref:o_custkey ?c ; col:o_orderstatus \"P\" } }",
    "select 'urn:customer:' || c_custkey as c from customer where c_mktsegment = 'BUILDING' and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
)
sparql(
    "exists_theta",
    "SELECT ?o WHERE { ?o col:o_totalprice ?t ; ref:o_custkey ?c FILTER EXISTS { ?p ref:o_custkey ?c ; col:o_totalprice ?u FILTER(?u > 3 * ?t) } }",
    "select 'urn:orders:' || o.o_orderkey as o from orders o where exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_totalprice > 3 * o.o_totalprice)",
)
sparql(
    "exists_in_disjunction",
    'SELECT ?c WHERE { ?c col:c_mktsegment ?m FILTER(?m = "MACHINERY" || EXISTS { ?o ref:o_custkey ?c ; col:o_orderstatus "P" }) }',
    "select 'urn:customer:' || c_custkey as c from customer where c_mktsegment = 'MACHINERY' or exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
)
sparql(
    "minus_suppliers",
    "SELECT ?n WHERE { ?k col:n_name ?n MINUS { ?s ref:s_nationkey ?k ; col:s_acctbal ?b FILTER(?b > 3000) } }",
    "select n_name as n from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 3000)",
)
sparql("minus_disjoint", "SELECT ?n WHERE { ?k col:n_name ?n MINUS { ?x col:r_name ?y } }", "select n_name as n from nation")
sparql(
    "union_padded",
    "SELECT ?a ?b WHERE { { ?k col:n_name ?a } UNION { ?k col:r_name ?b } }",
    "select n_name as a, null as b from nation union all select null, r_name from region",
)
sparql(
    "values_undef",
    'SELECT ?n ?r WHERE { VALUES (?n ?r) { ("FRANCE" UNDEF) (UNDEF "ASIA") } ?k col:n_name ?n ; ref:n_regionkey ?g . ?g col:r_name ?r }',
    "select n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey, (values ('FRANCE', null), (null, 'ASIA')) v(a, b) where (a is null or a = n_name) and (b is null or b = r_name)",
)
sparql(
    "values_join",
    "SELECT ?s ?t WHERE { ?o col:o_orderstatus ?s ; col:o_orderkey ?k ; col:o_totalprice ?t VALUES ?k { 1 2 3 4 5 6 7 32 33 } }",
    "select o_orderstatus as s, o_totalprice as t from orders where o_orderkey in (1, 2, 3, 4, 5, 6, 7, 32, 33)",
)
sparql(
    "subselect_top",
    """SELECT ?name ?total WHERE { { SELECT ?c (SUM(?t) AS ?total) WHERE { ?o ref:o_custkey ?c ; col:o_totalprice ?t } GROUP BY ?c ORDER BY DESC(SUM(?t)) LIMIT 5 } ?c col:c_name ?name }""",
    "select c_name as name, total from (select o_custkey, sum(o_totalprice) as total from orders group by 1 order by total desc limit 5) join customer on c_custkey = o_custkey",
)
sparql(
    "having_counts",
    "SELECT ?c (COUNT(?o) AS ?n) (MAX(?t) AS ?top) (MIN(?t) AS ?low) WHERE { ?o ref:o_custkey ?c ; col:o_totalprice ?t } GROUP BY ?c HAVING (COUNT(?o) > 12)",
    "select 'urn:customer:' || o_custkey as c, count(*) as n, max(o_totalprice) as top, min(o_totalprice) as low from orders group by o_custkey having count(*) > 12",
)
sparql(
    "aggregates_all",
    """SELECT ?s (COUNT(DISTINCT ?c) AS ?customers) (ROUND(AVG(?t)) AS ?mean) (SAMPLE(?s) AS ?some) (GROUP_CONCAT(DISTINCT ?p; SEPARATOR="|") AS ?priorities)
    WHERE { ?o col:o_orderstatus ?s ; ref:o_custkey ?c ; col:o_totalprice ?t ; col:o_orderpriority ?p } GROUP BY ?s""",
    """select o_orderstatus as s, count(distinct o_custkey) as customers, floor(avg(o_totalprice) + 0.5) as mean, max(o_orderstatus) as some,
      string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as priorities from orders group by 1""",
)
sparql("aggregate_empty", "SELECT (COUNT(*) AS ?n) (SUM(?t) AS ?s) WHERE { ?o col:o_totalprice ?t FILTER(?t < 0) }", "select 0 as n, 0.0::double as s")
sparql("count_distinct_rows", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?o col:o_orderstatus ?s ; col:o_orderpriority ?p }", "select count(*) as n from (select distinct o_orderkey, o_orderstatus, o_orderpriority from orders)")
sparql(
    "group_by_expression",
    "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o col:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
    "select year(o_orderdate) as y, count(*) as n from orders group by 1",
)
sparql("distinct_pairs", "SELECT DISTINCT ?s ?p WHERE { ?o col:o_orderstatus ?s ; col:o_orderpriority ?p }", "select distinct o_orderstatus as s, o_orderpriority as p from orders")
sparql(
    "distinct_semi_join",
    "SELECT DISTINCT ?name ?m WHERE { ?c col:c_name ?name ; col:c_mktsegment ?m . ?o ref:o_custkey ?c ; col:o_totalprice ?t . ?l ref:l_orderkey ?o ; col:l_returnflag \"R\" FILTER(?t > 100000 && ?m != \"BUILDING\") }",
    "select distinct c_name as name, c_mktsegment as m from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and o_totalprice > 100000 and c_mktsegment <> 'BUILDING'",
    ["customer", "orders", "lineitem"],
)
sparql("reduced_segments", "SELECT REDUCED ?m WHERE { ?c col:c_mktsegment ?m }", "select distinct c_mktsegment as m from customer")
sparql(
    "order_limit_offset",
    "SELECT ?k ?t WHERE { ?o col:o_orderkey ?k ; col:o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 20 OFFSET 10",
    "select o_orderkey as k, o_totalprice as t from orders order by t desc, k limit 20 offset 10",
)
sparql("stable_page", "SELECT ?k WHERE { ?o col:o_orderkey ?k } LIMIT 25 OFFSET 50", "select o_orderkey as k from orders order by 1 limit 25 offset 50")
sparql("cross_regions", "SELECT ?a ?b WHERE { ?x col:r_name ?a . ?y col:r_name ?b FILTER(?a < ?b) }", "select x.r_name as a, y.r_name as b from region x, region y where x.r_name < y.r_name")
sparql(
    "optional_two_filters",
    "SELECT ?c ?o WHERE { ?c col:c_acctbal ?b OPTIONAL { ?o ref:o_custkey ?c ; col:o_totalprice ?t ; col:o_orderstatus ?s FILTER(?t > 20 * ?b) FILTER(?s != \"F\") } }",
    "select 'urn:customer:' || c_custkey as c, 'urn:orders:' || o_orderkey as o from customer left join orders on o_custkey = c_custkey and o_totalprice > 20 * c_acctbal and o_orderstatus <> 'F'",
    ["customer", "orders"],
)
sparql(
    "optional_chain",
    "SELECT ?c ?o ?l WHERE { { ?c col:c_mktsegment \"BUILDING\" OPTIONAL { ?o ref:o_custkey ?c ; col:o_orderstatus \"P\" } FILTER(BOUND(?o)) } OPTIONAL { ?l ref:l_orderkey ?o ; col:l_returnflag \"R\" } }",
    """select 'urn:customer:' || c_custkey as c, 'urn:orders:' || o_orderkey as o, 'urn:lineitem:' || l_orderkey || '-' || l_linenumber as l from customer join orders on o_custkey = c_custkey and o_orderstatus = 'P'
      left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' where c_mktsegment = 'BUILDING'""",
    ["customer", "orders", "lineitem"],
)
sparql(
    "minus_optional",
    "SELECT ?c ?o WHERE { ?c col:c_acctbal ?b OPTIONAL { ?o ref:o_custkey ?c ; col:o_totalprice ?t FILTER(?t > 300000) } MINUS { ?o col:o_orderpriority \"1-URGENT\" } }",
    "select 'urn:customer:' || c_custkey as c, 'urn:orders:' || o_orderkey as o from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000 where o_orderpriority is null or o_orderpriority <> '1-URGENT'",
    ["customer", "orders"],
)
sparql(
    "nested_not_exists",
    "SELECT ?c WHERE { ?c col:c_mktsegment ?m FILTER NOT EXISTS { { SELECT DISTINCT ?p WHERE { ?x col:o_orderpriority ?p } } FILTER NOT EXISTS { ?o ref:o_custkey ?c ; col:o_orderpriority ?p } } }",
    "select 'urn:customer:' || c_custkey as c from customer where c_custkey in (select o_custkey from orders group by 1 having count(distinct o_orderpriority) = (select count(distinct o_orderpriority) from orders))",
    ["customer", "orders"],
)
sparql(
    "nested_exists_pairs",
    "SELECT ?n WHERE { ?n col:n_name ?name FILTER NOT EXISTS { ?s ref:s_nationkey ?n ; col:s_acctbal ?b FILTER NOT EXISTS { ?c ref:c_nationkey ?n ; col:c_acctbal ?d FILTER(?d > ?b) } } }",
    "select 'urn:nation:' || n_nationkey as n from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal >= coalesce((select max(c_acctbal) from customer where c_nationkey = n_nationkey), -1e9))",
    ["nation", "supplier", "customer"],
)
sparql(
    "values_after_group",
    "SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o ref:o_custkey ?c } GROUP BY ?c VALUES ?k { 10 11 }",
    "select 'urn:customer:' || o_custkey as c, cast(count(*) as varchar) as k from orders group by 1 having count(*) in (10, 11)",
    ["orders"],
)
sparql(
    "exists_in_aggregate",
    "SELECT ?m (SUM(IF(EXISTS { ?o ref:o_custkey ?c ; col:o_orderstatus \"P\" }, 1, 0)) AS ?n) WHERE { ?c col:c_mktsegment ?m } GROUP BY ?m",
    "select c_mktsegment as m, sum(case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 1 else 0 end)::bigint as n from customer group by 1",
    ["customer", "orders"],
)
sparql(
    "exists_in_order",
    "SELECT ?k WHERE { ?c col:c_custkey ?k } ORDER BY DESC(EXISTS { ?o ref:o_custkey ?c ; col:o_orderstatus \"P\" }) ?k LIMIT 50",
    "select c_custkey as k from customer order by case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 0 else 1 end, k limit 50",
    ["customer", "orders"],
)
# the same graph as quads
sparql(
    "decimal_arithmetic",
    "SELECT ?k (STR(xsd:decimal(STR(?t)) + 0.1 + 0.2) AS ?x) (xsd:decimal(STR(?t)) * 3 = xsd:decimal(STR(?t)) + xsd:decimal(STR(?t)) * 2 AS ?y) WHERE { ?o col:o_orderkey ?k ; col:o_totalprice ?t }",
    "select o_orderkey::varchar as k, regexp_replace(regexp_replace(v, '0+$', ''), '[.]$', '.0') as x, true as y from (select o_orderkey, (o_totalprice::varchar::decimal(28,9) + 0.3)::varchar as v from orders)",
    quads=["orders"],
)
sparql(
    "big_integers",
    "SELECT (SUM(?k + 9007199254740993) AS ?s) (MAX(?k + 9007199254740993) AS ?m) (MIN(?k * 3 - 9007199254740993) AS ?l) WHERE { ?o col:o_orderkey ?k }",
    "select cast(sum(o_orderkey::hugeint + 9007199254740993) as varchar) as s, cast(max(o_orderkey::hugeint + 9007199254740993) as varchar) as m, cast(min(o_orderkey::hugeint * 3 - 9007199254740993) as varchar) as l from orders",
    quads=["orders"],
)
WHOLE = ["customer", "nation", "region"]
sparql(
    "distinct_predicates",
    "SELECT DISTINCT ?p WHERE { ?s ?p ?o }",
    "select unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:ref:o_custkey', 'urn:col:o_orderkey', 'urn:col:o_custkey', 'urn:col:o_orderstatus', 'urn:col:o_totalprice', 'urn:col:o_orderdate', 'urn:col:o_orderpriority']) as p",
    quads=["orders"],
)
sparql("triple_count", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", "select (select 8 * count(*) from orders) as n", quads=["orders"])
sparql("quads_star", "SELECT ?n ?r WHERE { ?k col:c_name ?n ; ref:c_nationkey ?g . ?g col:n_name ?r FILTER(CONTAINS(?n, '1')) }", "select c_name as n, n_name as r from customer join nation on c_nationkey = n_nationkey where contains(c_name, '1')", quads=WHOLE)
sparql("entity_degree", "SELECT ?o (COUNT(?s) AS ?n) WHERE { ?s ref:o_custkey ?o } GROUP BY ?o", "select 'urn:customer:' || o_custkey as o, count(*) as n from orders group by o_custkey", quads=["orders"])
sparql("path_sequence", "SELECT ?c ?r WHERE { ?c ref:c_nationkey/ref:n_regionkey/col:r_name ?r }", "select 'urn:customer:' || c_custkey as c, r_name as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", quads=WHOLE)
sparql("path_inverse", "SELECT ?r ?n WHERE { ?r ^ref:c_nationkey/col:c_name ?n }", "select 'urn:nation:' || c_nationkey as r, c_name as n from customer", quads=WHOLE)
sparql("path_alternative", "SELECT ?x ?n WHERE { ?x col:c_name|col:n_name|col:r_name ?n }", "select 'urn:customer:' || c_custkey as x, c_name as n from customer union all select 'urn:nation:' || n_nationkey, n_name from nation union all select 'urn:region:' || r_regionkey, r_name from region", quads=WHOLE)
sparql("path_optional", "SELECT ?x ?y WHERE { ?x col:c_mktsegment \"BUILDING\" . ?x ref:c_nationkey? ?y }", "select 'urn:customer:' || c_custkey as x, unnest(['urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey]) as y from customer where c_mktsegment = 'BUILDING'", quads=WHOLE)
sparql(
    "path_closure",
    "SELECT ?x ?y WHERE { ?x (ref:o_custkey|ref:c_nationkey|ref:n_regionkey)+ ?y }",
    """with recursive e(a, b) as (select 'urn:orders:' || o_orderkey, 'urn:customer:' || o_custkey from orders union select 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey from customer
      union select 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey from nation),
      c(x, y) as (select a, b from e union select x, b from c join e on y = a) select x, y from c""",
    quads=["orders", *WHOLE],
)
sparql("path_star_bound", "SELECT ?y WHERE { <urn:customer:7> (ref:c_nationkey|ref:n_regionkey)* ?y }", "select 'urn:customer:7' as y union select 'urn:nation:' || c_nationkey from customer where c_custkey = 7 union select 'urn:region:' || n_regionkey from nation join customer on c_nationkey = n_nationkey where c_custkey = 7", quads=WHOLE)
sparql("path_zero_to_two", "SELECT ?y WHERE { <urn:customer:7> (ref:c_nationkey|ref:n_regionkey){0,2} ?y }", "select 'urn:customer:7' as y union select 'urn:nation:' || c_nationkey from customer where c_custkey = 7 union select 'urn:region:' || n_regionkey from nation join customer on c_nationkey = n_nationkey where c_custkey = 7", quads=WHOLE)
sparql("path_zero_unknown", "SELECT ?y WHERE { <urn:not:there> ref:c_nationkey{0,2} ?y }", "select 'urn:not:there' as y", quads=WHOLE)
sparql("path_cycle", "SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x (ref:n_regionkey/^ref:n_regionkey)+ ?y } GROUP BY ?x", "select 'urn:nation:' || a.n_nationkey as x, count(*) as n from nation a join nation b using (n_regionkey) group by a.n_nationkey", quads=WHOLE)
sparql("path_negated", "SELECT ?x ?y WHERE { ?x !(col:o_orderkey|col:o_custkey|col:o_orderstatus|col:o_totalprice|col:o_orderdate|col:o_orderpriority|rdf:type) ?y }", "select 'urn:orders:' || o_orderkey as x, 'urn:customer:' || o_custkey as y from orders", quads=["orders"])
sparql("path_counted", "SELECT ?x ?y WHERE { ?x (ref:c_nationkey|ref:n_regionkey){2} ?y }", "select 'urn:customer:' || c_custkey as x, 'urn:region:' || n_regionkey as y from customer join nation on c_nationkey = n_nationkey", quads=WHOLE)
sparql("construct_regions", "CONSTRUCT { ?g <urn:has> ?k } WHERE { ?k ref:c_nationkey ?g }", "select distinct 'Iurn:nation:' || c_nationkey as s, 'Iurn:has' as p, 'Iurn:customer:' || c_custkey as o from customer")
sparql("describe_region", "DESCRIBE <urn:region:1>", "select 'Iurn:region:1' as s, 'Iurn:col:r_name' as p, 'S' || r_name as o from region where r_regionkey = 1 union all select 'Iurn:region:1', 'Iurn:col:r_regionkey', 'Thttp://www.w3.org/2001/XMLSchema#integer 1' union all select 'Iurn:region:1', 'Ihttp://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'Iurn:table:region'", quads=WHOLE)


def graphs_engine(spark, sf_dir):
    """Customers in a named graph for each segment, everything else in the default graph."""
    quads = star_store(spark, sf_dir, WHOLE).quads()
    segment = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("Iurn:customer:"), "c_custkey").alias("s"), F.concat(F.lit("Iurn:segment:"), "c_mktsegment").alias("own"))
    return Engine(QuadStore(quads.join(segment, "s", "left").select("s", "p", "o", F.coalesce("own", "g").alias("g"))), PREFIXES)


def in_graphs(name: str, query: str, oracle: str):
    QUERIES[name], ORACLES[name] = (lambda spark, sf_dir: graphs_engine(spark, sf_dir).query(query)), oracle


in_graphs("graph_enumeration", "SELECT ?g WHERE { GRAPH ?g { } }", "select distinct 'urn:segment:' || c_mktsegment as g from customer")
in_graphs("graph_variable", "SELECT ?g ?n WHERE { GRAPH ?g { SELECT (COUNT(?c) AS ?n) WHERE { ?c col:c_name ?name } } }", "select 'urn:segment:' || c_mktsegment as g, count(*) as n from customer group by 1")
in_graphs("graph_constant", "SELECT ?c FROM NAMED <urn:segment:BUILDING> WHERE { GRAPH <urn:segment:BUILDING> { ?c ref:c_nationkey <urn:nation:3> } }", "select 'urn:customer:' || c_custkey as c from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
