"""RDF terms as canonical strings.

A term is one string whose first character tells its kind, so that term identity is string equality
and joins, grouping and set operations need no dictionary:

    I<iri>   B<label>   S<lexical>   G<lang> <lexical>   T<datatype> <lexical>

xsd:string literals are S, language tags are lower-cased. An unbound variable is null.
"""

from __future__ import annotations

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"
STRING = XSD + "string"

# The numeric datatypes of XML Schema, those that act as integers first.
INTEGERS = [XSD + x for x in "integer int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()]
NUMERICS = [*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double"]


def iri(value: str) -> str:
    return "I" + value


def blank(label: str) -> str:
    return "B" + label


def literal(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    if lang:
        return f"G{lang.lower()} {lexical}"
    if datatype and datatype != STRING:
        return f"T{datatype} {lexical}"
    return "S" + lexical


def integer(value: int) -> str:
    return literal(str(value), XSD + "integer")


def boolean(value: bool) -> str:
    return literal("true" if value else "false", XSD + "boolean")


def parts(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, text, lang, datatype) with kind U, B or L."""
    head, body = term[0], term[1:]
    if head in "IB":
        return ("U" if head == "I" else "B"), body, None, None
    if head == "S":
        return "L", body, None, STRING
    tag, _, text = body.partition(" ")
    return ("L", text, tag, LANG_STRING) if head == "G" else ("L", text, None, tag)
