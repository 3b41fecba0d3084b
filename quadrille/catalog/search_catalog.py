"""Vector, text, hybrid, fuzzy and geographic search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.measures import hashing_embedder
from ..functions.search import NS, fused
from ..engine import Engine
from ..sources.store import TableMap, TableStore

QUERIES, ORACLES = {}, {}
FIND = {"find": NS, "col": "urn:col:"}
PROBE = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
SQL_PROBE = "[" + ", ".join(map(str, PROBE)) + "]::double[]"
COS = f"list_cosine_similarity(embedding::double[], {SQL_PROBE})"
LAT, LON = "((c_custkey * 37) % 180 - 90)", "((c_custkey * 71) % 360 - 180)"


def engine(spark, sf_dir: str) -> Engine:
    """Embeddings, documents and customers with their side tables."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    vectors, docs, customers = read("embeddings"), read("documents"), read("customer")
    indexes = {
        "vectors": vectors.select(F.concat(F.lit("Iurn:embeddings:"), "vec_id").alias("s"), F.col("embedding").alias("vector")),
        "texts": docs.select(F.concat(F.lit("Iurn:documents:"), "doc_id").alias("s"), "text"),
        ("text", "hybrid"): docs.select(F.concat(F.lit("Iurn:documents:"), "doc_id").alias("s"), "text"),
        ("vector", "hybrid"): vectors.select(F.concat(F.lit("Iurn:documents:"), "vec_id").alias("s"), F.col("embedding").alias("vector")),
        "names": customers.select(F.concat(F.lit("Iurn:customer:"), "c_custkey").alias("s"), F.col("c_name").alias("name")),
        "places": customers.select(F.concat(F.lit("Iurn:customer:"), "c_custkey").alias("s"), F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon")),
    }
    store = TableStore(spark, [TableMap("embeddings", vectors, ["vec_id"]), TableMap("documents", docs, ["doc_id"]), TableMap("customer", customers, ["c_custkey"])])
    return Engine(store, FIND, indexes=indexes, embed=hashing_embedder())


def sparql(name: str, query: str, oracle: str | None):
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).query(query)
    if oracle:
        ORACLES[name] = oracle


VEC = f'find:vectorNearby(?e, "{PROBE}", "vectors")'
sparql("vector_top_k", f"SELECT ?k (ROUND(?s * 1000000) AS ?score) WHERE {{ ?e col:vec_id ?k BIND({VEC} AS ?s) }} ORDER BY DESC(?s) ?k LIMIT 20", f"select vec_id as k, floor({COS} * 1000000 + 0.5) as score from embeddings order by {COS} desc, k limit 20")
sparql("order_by_search", f"SELECT ?k WHERE {{ ?e col:vec_id ?k }} ORDER BY DESC({VEC}) ?k LIMIT 20", f"select vec_id as k from embeddings order by {COS} desc, k limit 20")
sparql("search_in_aggregate", f"SELECT ?l (ROUND(MAX({VEC}) * 1000000) AS ?best) WHERE {{ ?e col:label ?l }} GROUP BY ?l", f"select label as l, floor(max({COS}) * 1000000 + 0.5) as best from embeddings group by label")
sparql("search_in_optional", f"SELECT ?k ?f WHERE {{ ?e col:vec_id ?k OPTIONAL {{ ?f col:vec_id ?k FILTER({VEC.replace('?e', '?f')} > 0.1) }} }}", f"select vec_id as k, case when {COS} > 0.1 then 'urn:embeddings:' || vec_id end as f from embeddings")
sparql("vector_threshold", f"SELECT ?k WHERE {{ ?e col:vec_id ?k FILTER({VEC} > 0.2) }}", f"select vec_id as k from embeddings where {COS} > 0.2")
sparql("multi_vector", f'SELECT ?k (ROUND(find:multiVectorNearby(?e, ("{PROBE}", "vectors", 3), ("{PROBE[::-1]}", "vectors", 1)) * 100000) AS ?score) WHERE {{ ?e col:vec_id ?k }}', f"select vec_id as k, floor((0.75 * {COS} + 0.25 * list_cosine_similarity(embedding::double[], {list(PROBE[::-1])}::double[])) * 100000 + 0.5) as score from embeddings")
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
sparql("text_search", 'SELECT ?k (ROUND(?s * 1000000) AS ?score) WHERE { ?d col:doc_id ?k BIND(find:textSearch(?d, "license public", "texts") AS ?s) FILTER(BOUND(?s)) }', f"select doc_id as k, floor(len(list_filter({WORDS}, lambda w: w in ('license', 'public'))) / len({WORDS}) * 1000000 + 0.5) as score from documents where list_contains({WORDS}, 'license') and list_contains({WORDS}, 'public')")
ASKED = f"{hashing_embedder()('public license')}::double[]"
NEAR = f"list_cosine_similarity(embedding::double[], {ASKED})"
FTS = f"case when list_contains({WORDS}, 'license') and list_contains({WORDS}, 'public') then len(list_filter({WORDS}, lambda w: w in ('license', 'public'))) / len({WORDS}) end"
GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
sparql(
    "hybrid_search",
    'SELECT ?k (ROUND(?s * 1000000) AS ?score) WHERE { ?d col:doc_id ?k BIND(find:hybridSearch(?d, "license public", "hybrid", 0.5) AS ?s) FILTER(BOUND(?s)) }',
    f"""with j as (select doc_id, {FTS} as fts, {NEAR} as near from documents left join embeddings on doc_id = vec_id)
    select doc_id as k, floor((0.5 * coalesce(fts, 0) + 0.5 * coalesce(near, 0)) * 1000000 + 0.5) as score from j where fts is not null or 1 - near < 0.6""",
)
sparql("vector_similarity_text", 'SELECT ?k (ROUND(?s * 1000000) AS ?score) WHERE { ?e col:vec_id ?k BIND(find:vectorSimilarity(?e, "public license", "vectors") AS ?s) FILTER(?s > 0.1) }', f"select vec_id as k, floor({NEAR} * 1000000 + 0.5) as score from embeddings where {NEAR} > 0.1")
sparql(
    "trigram_similarity",
    'SELECT ?k (ROUND(?s * 1000000) AS ?score) WHERE { ?c col:c_custkey ?k BIND(find:trigramSimilarity(?c, "Customer#000000042") AS ?s) FILTER(?s > 0.6) }',
    f"""with g as (select c_custkey as k, {GRAMS.format('c_name')} as x, {GRAMS.format("'Customer#000000042'")} as y from customer), s as (select k, len(list_intersect(x, y)) as n, len(x) + len(y) as m from g)
    select k, floor(n / (m - n) * 1000000 + 0.5) as score from s where n / (m - n) > 0.6""",
)
sparql("fuzzy_match", 'SELECT ?k ?s WHERE { ?c col:c_custkey ?k BIND(find:fuzzyMatch(?c, "customer 000000124", 97) AS ?s) FILTER(BOUND(?s)) }', "select c_custkey as k, 100.0::double as s from customer where c_name = 'Customer#000000124'")
HAV = f"2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(40.758 - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(40.758)) * pow(sin(radians(-73.9855 - {LON}) / 2), 2))))"
sparql("geo_distance", "SELECT ?k (ROUND(find:geoDistance(?c, 40.758, -73.9855)) AS ?m) WHERE { ?c col:c_custkey ?k }", f"select c_custkey as k, floor({HAV} + 0.5) as m from customer")
sparql("geo_radius", "SELECT ?k WHERE { ?c col:c_custkey ?k FILTER(find:withinRadius(?c, 40.758, -73.9855, 1500000)) }", f"select c_custkey as k from customer where {HAV} <= 1500000")
sparql("geo_bounds", "SELECT ?k WHERE { ?c col:c_custkey ?k FILTER(find:withinBounds(?c, 10, -20, 60, 40)) }", f"select c_custkey as k from customer where {LAT} between 10 and 60 and {LON} between -20 and 40")
sparql("geo_polygon", 'SELECT ?k WHERE { ?c col:c_custkey ?k FILTER(find:withinPolygon(?c, "POLYGON((-20.5 10.5, 40.5 10.5, 40.5 60.5, -20.5 60.5, -20.5 10.5))")) }', f"select c_custkey as k from customer where {LAT} between 11 and 60 and {LON} between -20 and 40")


def fusion_ranked(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return fused(v, ["x", "y"], "ranked").select("vec_id", F.round("score", 9).alias("score"))


def fusion_relative(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return fused(v, ["x", "y"], "relative_score", [2.0, 1.0]).select("vec_id", F.round("score", 6).alias("score"))


def fuzzy_duplicates(spark, sf_dir):
    """Suppliers beside copies whose names are written with a blank."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    other = own.select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), F.regexp_replace("s_name", "#", " #").alias("s_name"))
    return fuzzy.duplicates(own.unionByName(other), 99.0, "s_suppkey", "s_name")


def fuzzy_find_similar(spark, sf_dir):
    """Every name has the code of the query's word, so all are candidates; what counts are the digits."""
    return fuzzy.find_similar(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "Suplier#000000012", 99.0, "s_suppkey", "s_name")


QUERIES |= {"fusion_ranked": fusion_ranked, "fusion_relative": fusion_relative, "fuzzy_duplicates": fuzzy_duplicates, "fuzzy_find_similar": fuzzy_find_similar}
E2 = "select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings"
ORACLES |= {
    "fuzzy_duplicates": "select s_suppkey as a, s_suppkey + 1000000 as b, 100.0::double as score from supplier",
    # 9 digits and 7 of 8 letters are common to the equal number, and a digit less leaves 200 * 16 / 35 + 10 still at the cap
    "fuzzy_find_similar": "select s_suppkey as id, s_name as name, 100.0::double as score, 'high' as level from supplier where s_suppkey < 100 and (s_suppkey = 12 or s_suppkey // 10 in (1, 2) or s_suppkey % 10 in (1, 2))",
    "fusion_ranked": f"select vec_id, round(0.5 / (60 + row_number() over (order by x desc, vec_id)) + 0.5 / (60 + row_number() over (order by y desc, vec_id)), 9) as score from ({E2})",
    "fusion_relative": f"select vec_id, round(2.0 / 3 * (x - min(x) over ()) / (max(x) over () - min(x) over ()) + 1.0 / 3 * (y - min(y) over ()) / (max(y) over () - min(y) over ()), 6) as score from ({E2})",
}
