"""Updates and their effects on a snapshot, and round trips through the line formats."""

from __future__ import annotations

from ..operators.updates import effects
from ..sources.rdf_files import parse_lines, to_lines
from ..sources.star_schema import PREFIXES, star_store

QUERIES, ORACLES = {}, {}
NATION = ("select 'Iurn:nation:' || n_nationkey as s, 'Iurn:col:n_name' as p, 'S' || n_name as o from nation")


def update(name: str, text: str, oracle: str, tables: tuple[str, ...] = ("nation", "region")):
    """The changes an update makes, as (s, p, o, g, change)."""

    def run(spark, sf_dir):
        old = star_store(spark, sf_dir, list(tables)).quads()
        return effects(old, text, PREFIXES)

    QUERIES[name], ORACLES[name] = run, oracle


D = "'Iurn:quadrille:default' as g"
update("insert_data", 'INSERT DATA { <urn:a> <urn:p> 1, "x"@en . GRAPH <urn:g> { <urn:a> <urn:p> <urn:b> } }', f"select 'Iurn:a' as s, 'Iurn:p' as p, 'Thttp://www.w3.org/2001/XMLSchema#integer 1' as o, {D}, 'added' as change union all select 'Iurn:a', 'Iurn:p', 'Gen x', 'Iurn:quadrille:default', 'added' union all select 'Iurn:a', 'Iurn:p', 'Iurn:b', 'Iurn:g', 'added'")
update("delete_data", "DELETE DATA { <urn:nation:3> ref:n_regionkey <urn:region:1> . <urn:none> <urn:none> 1 }", f"select 'Iurn:nation:3' as s, 'Iurn:ref:n_regionkey' as p, 'Iurn:region:1' as o, {D}, 'removed' as change from nation where n_nationkey = 3 and n_regionkey = 1")
update("delete_where", "DELETE WHERE { ?x col:n_name ?n }", f"select s, p, o, {D}, 'removed' as change from ({NATION})")
update(
    "delete_insert_where",
    "DELETE { ?x col:n_name ?n } INSERT { ?x col:n_name ?u } WHERE { ?x col:n_name ?n ; col:n_regionkey 1 BIND(LCASE(?n) AS ?u) }",
    f"select 'Iurn:nation:' || n_nationkey as s, 'Iurn:col:n_name' as p, 'S' || n_name as o, {D}, 'removed' as change from nation where n_regionkey = 1 union all select 'Iurn:nation:' || n_nationkey, 'Iurn:col:n_name', 'S' || lower(n_name), 'Iurn:quadrille:default', 'added' from nation where n_regionkey = 1",
)
ORDERS = "select 'Iurn:orders:' || o_orderkey as s from orders where o_orderstatus = 'P'"
update(
    "with_and_graph",
    'INSERT { GRAPH <urn:h> { ?o <urn:open> true } } WHERE { ?o col:o_orderstatus "P" } ; WITH <urn:g> INSERT { ?o <urn:seen> ?x } WHERE { GRAPH <urn:h> { ?o <urn:open> ?x } }',
    f"select s, 'Iurn:open' as p, 'Thttp://www.w3.org/2001/XMLSchema#boolean true' as o, 'Iurn:h' as g, 'added' as change from ({ORDERS}) union all select s, 'Iurn:seen', 'Thttp://www.w3.org/2001/XMLSchema#boolean true', 'Iurn:g', 'added' from ({ORDERS})",
    ("orders",),
)
update("insert_unbound_skipped", "INSERT { ?x <urn:q> ?missing . ?x <urn:r> 1 } WHERE { ?x col:r_regionkey 2 OPTIONAL { ?x <urn:none> ?missing } }", f"select 'Iurn:region:2' as s, 'Iurn:r' as p, 'Thttp://www.w3.org/2001/XMLSchema#integer 1' as o, {D}, 'added' as change")
update("copy_graph", "INSERT DATA { GRAPH <urn:h> { <urn:x> <urn:y> 1 } } ; COPY DEFAULT TO <urn:g> ; CLEAR GRAPH <urn:h>", "select s, p, o, 'Iurn:g' as g, 'added' as change from (select 'Iurn:region:' || r_regionkey as s, 'Iurn:col:r_name' as p, 'S' || r_name as o from region union all select 'Iurn:region:' || r_regionkey, 'Iurn:col:r_regionkey', 'Thttp://www.w3.org/2001/XMLSchema#integer ' || r_regionkey from region union all select 'Iurn:region:' || r_regionkey, 'Ihttp://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'Iurn:table:region' from region)", ("region",))
update("move_graph", "MOVE DEFAULT TO <urn:g> ; MOVE <urn:g> TO DEFAULT ; ADD DEFAULT TO DEFAULT", f"select '' as s, '' as p, '' as o, {D}, '' as change where false", ("region",))
update("clear_default", "CLEAR DEFAULT ; CREATE GRAPH <urn:n> ; DROP SILENT GRAPH <urn:n>", f"select s, p, o, {D}, 'removed' as change from (select 'Iurn:region:' || r_regionkey as s, 'Iurn:col:r_name' as p, 'S' || r_name as o from region union all select 'Iurn:region:' || r_regionkey, 'Iurn:col:r_regionkey', 'Thttp://www.w3.org/2001/XMLSchema#integer ' || r_regionkey from region union all select 'Iurn:region:' || r_regionkey, 'Ihttp://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'Iurn:table:region' from region)", ("region",))


def nquads_lines(spark, sf_dir):
    return to_lines(star_store(spark, sf_dir, ["region"]).quads().where("p = 'Iurn:col:r_name'"))


def nquads_round_trip(spark, sf_dir):
    """Documents' texts written as N-Quads lines and parsed again."""
    quads = star_store(spark, sf_dir, ["documents"]).quads(["Iurn:col:text"])
    return parse_lines(to_lines(quads)).selectExpr("s", "substr(o, 2) as text")


QUERIES |= {"nquads_lines": nquads_lines, "nquads_round_trip": nquads_round_trip}
ORACLES |= {
    "nquads_lines": "select '<urn:region:' || r_regionkey || '> <urn:col:r_name> \"' || r_name || '\" .' as value from region",
    "nquads_round_trip": "select 'Iurn:documents:' || doc_id as s, text from documents where text is not null",
}
