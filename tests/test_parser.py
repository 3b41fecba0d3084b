import pytest

from quadrille.plans import algebra as A
from quadrille.plans.parser import ParseError, parse_query, parse_update


def test_group_with_having_and_order():
    q = parse_query("SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x <u:p> ?y } GROUP BY ?x HAVING (COUNT(?y) > 1) ORDER BY DESC(?n) LIMIT 3 OFFSET 1")
    assert isinstance(q.pattern, A.Slice) and (q.pattern.limit, q.pattern.offset) == (3, 1)
    assert q.names == ["x", "n"]


def test_negative_number_in_expression():
    q = parse_query("SELECT (1 + -2.5 AS ?x) WHERE {}")
    assert "decimal -2.5" in repr(q.pattern)


def test_paths_and_lists():
    q = parse_query("SELECT * WHERE { ?s <u:a>/(^<u:b>|!<u:c>)* ?o . ?s <u:l> (1 2) }")
    assert "Repeat" in repr(q.pattern) and "22-rdf-syntax-ns#first" in repr(q.pattern)


def test_optional_filter_is_the_join_condition():
    q = parse_query("SELECT * WHERE { ?s <u:a> ?x OPTIONAL { ?s <u:b> ?y FILTER(?y > ?x) } }")
    assert q.pattern.condition is not None


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x <u:p> }", "SELECT ?x { ?x x:y 1 }", "SELECT * WHERE { BIND(1 AS ?x) BIND(2 AS ?x) }", "SELECT * { SERVICE <u:s> { ?a ?b ?c } }"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse_query(text)


def test_updates():
    kinds = [u.kind for u in parse_update("PREFIX u: <u:> INSERT DATA { u:a u:b 1 } ; WITH u:g DELETE { ?s u:b ?o } WHERE { ?s u:b ?o } ; MOVE u:g TO DEFAULT ; DROP SILENT ALL")]
    assert kinds == ["insert_data", "modify", "move", "clear"]
