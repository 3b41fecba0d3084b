"""Scalar functions and operators, applied to whole tables."""

from __future__ import annotations

from ..sources.star_schema import star_engine

QUERIES, ORACLES = {}, {}


def sparql(name: str, query: str, oracle: str, tables: list[str]):
    QUERIES[name] = lambda spark, sf_dir: star_engine(spark, sf_dir, tables).query(query)
    ORACLES[name] = oracle


def projected(name: str, pattern: str, columns: dict[str, tuple[str, str]], source: str, table: str):
    """columns: name -> (SPARQL expression, SQL expression)."""
    query = "SELECT ?k " + " ".join(f"({a} AS ?{c})" for c, (a, _) in columns.items()) + f" WHERE {{ {pattern} }}"
    sql = "select " + source + " as k, " + ", ".join(f"{b} as {c}" for c, (_, b) in columns.items()) + f" from {table}"
    sparql(name, query, sql, [table])


NAME = '?x col:c_custkey ?k ; col:c_name ?n ; col:c_acctbal ?b ; col:c_mktsegment ?m'
projected(
    "string_functions",
    NAME,
    {
        "len": ("STRLEN(?n)", "length(c_name)"),
        "up": ("UCASE(?n)", "upper(c_name)"),
        "low": ("LCASE(?n)", "lower(c_name)"),
        "part": ("SUBSTR(?n, 3)", "substr(c_name, 3)"),
        "cut": ("SUBSTR(?n, 2, 4)", "substr(c_name, 2, 4)"),
        "starts": ('STRSTARTS(?m, "B")', "starts_with(c_mktsegment, 'B')"),
        "ends": ('STRENDS(?m, "Y")', "ends_with(c_mktsegment, 'Y')"),
        "has": ('CONTAINS(?m, "IL")', "contains(c_mktsegment, 'IL')"),
        "both": ('CONCAT(?n, "/", ?m)', "c_name || '/' || c_mktsegment"),
        "enc": ('ENCODE_FOR_URI(CONCAT(?n, " ~*", ?m))', "replace(replace(c_name, '#', '%23'), ' ', '%20') || '%20~%2A' || c_mktsegment"),
        "rep": ('REPLACE(?m, "[AEIOU]", "_")', "regexp_replace(c_mktsegment, '[AEIOU]', '_', 'g')"),
        "rx": ('REGEX(?m, "^b.*g$", "i")', "regexp_matches(c_mktsegment, '(?i)^b.*g$')"),
    },
    "c_custkey",
    "customer",
)
projected(
    "string_splits",
    NAME,
    {
        "before": ('STRBEFORE(?n, "#")', "case when instr(c_name, '#') > 0 then substr(c_name, 1, instr(c_name, '#') - 1) else '' end"),
        "after": ('STRAFTER(?n, "#")', "case when instr(c_name, '#') > 0 then substr(c_name, instr(c_name, '#') + 1) else '' end"),
        "none": ('STRBEFORE(?n, "zzz")', "''"),
    },
    "c_custkey",
    "customer",
)
projected(
    "numeric_functions",
    NAME,
    {
        "a": ("ABS(?b)", "abs(c_acctbal)"),
        "c": ("CEIL(?b)", "ceil(c_acctbal)"),
        "f": ("FLOOR(?b)", "floor(c_acctbal)"),
        "r": ("ROUND(?b)", "floor(c_acctbal + 0.5)"),
        "sum": ("?k + ?b", "c_custkey + c_acctbal"),
        "diff": ("?k - 7", "c_custkey - 7"),
        "prod": ("?b * 2", "c_acctbal * 2"),
        "neg": ("-?k", "-c_custkey"),
        "div0": ("?b / 0", "null"),
    },
    "c_custkey",
    "customer",
)
projected(
    "conditional_functions",
    NAME,
    {
        "side": ('IF(?b < 0, "debt", "credit")', "case when c_acctbal < 0 then 'debt' else 'credit' end"),
        "first": ("COALESCE(?missing, ?n)", "c_name"),
        "bound": ("BOUND(?missing)", "false"),
        "inlist": ('?m IN ("BUILDING", "MACHINERY")', "c_mktsegment in ('BUILDING', 'MACHINERY')"),
        "notin": ('?m NOT IN ("BUILDING")', "c_mktsegment <> 'BUILDING'"),
        "logic": ("?b > 0 && ?k > 10 || !(?k < 5)", "(c_acctbal > 0 and c_custkey > 10) or not (c_custkey < 5)"),
        "err": ("?missing || true", "true"),
    },
    "c_custkey",
    "customer",
)
projected(
    "kind_functions",
    NAME,
    {
        "iri": ("ISIRI(?x)", "true"),
        "lit": ("ISLITERAL(?n)", "true"),
        "num": ("ISNUMERIC(?b)", "true"),
        "nonum": ("ISNUMERIC(?n)", "false"),
        "blank": ("ISBLANK(?x)", "false"),
        "s": ("STR(?x)", "'urn:customer:' || c_custkey"),
        "d": ("STR(DATATYPE(?b))", "'http://www.w3.org/2001/XMLSchema#double'"),
        "l": ("LANG(?n)", "''"),
        "same": ("SAMETERM(?k, ?k)", "true"),
        "tagged": ('LANG(STRLANG(?n, "EN"))', "'en'"),
        "match": ('LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "en")', "true"),
        "typed": ('DATATYPE(STRDT(?n, <urn:t>))', "'urn:t'"),
        "made": ('IRI(CONCAT("urn:made:", ?n))', "'urn:made:' || c_name"),
    },
    "c_custkey",
    "customer",
)
projected(
    "hash_functions",
    NAME,
    {"h1": ("MD5(?n)", "md5(c_name)"), "h2": ("SHA1(?n)", "sha1(c_name)"), "h3": ("SHA256(?n)", "sha256(c_name)"), "h4": ("STRLEN(SHA384(?n))", "96"), "h5": ("STRLEN(SHA512(?n))", "128"), "u": ("STRLEN(STRUUID())", "36"), "r": ("RAND() < 1", "true")},
    "c_custkey",
    "customer",
)
projected(
    "date_functions",
    "?x col:o_orderkey ?k ; col:o_orderdate ?d",
    {
        "y": ("YEAR(?d)", "year(o_orderdate)"),
        "m": ("MONTH(?d)", "month(o_orderdate)"),
        "dd": ("DAY(?d)", "day(o_orderdate)"),
        "h": ("HOURS(?d)", "hour(o_orderdate)"),
        "mi": ("MINUTES(?d)", "minute(o_orderdate)"),
        "tz": ("TZ(?d)", "''"),
        "zone": ('STR(TIMEZONE("2011-01-10T14:45:13-05:00"^^xsd:dateTime))', "'-PT5H'"),
        "later": ('?d > "1995-06-01T00:00:00"^^xsd:dateTime', "o_orderdate > timestamp '1995-06-01'"),
        "now": ("NOW() > ?d", "true"),
    },
    "o_orderkey",
    "orders",
)
projected(
    "cast_functions",
    NAME,
    {
        "i": ("xsd:integer(?b)", "cast(trunc(c_acctbal) as bigint)"),
        "dbl": ("xsd:double(STR(?k))", "cast(c_custkey as double)"),
        "st": ("xsd:string(?k)", "cast(c_custkey as varchar)"),
        "bo": ("xsd:boolean(?k)", "c_custkey <> 0"),
        "bad": ("xsd:integer(?n)", "null"),
    },
    "c_custkey",
    "customer",
)
sparql(
    "order_by_kinds",
    "SELECT ?v WHERE { { ?x col:r_name ?v } UNION { ?x col:r_regionkey ?v } UNION { ?v col:r_regionkey 1 } } ORDER BY ?v",
    "select r_name as v from region union all select cast(r_regionkey as varchar) from region union all select 'urn:region:1'",
    ["region"],
)
