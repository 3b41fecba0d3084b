"""Expression values: a Column and what is known of its type while the plan is built.

``term`` values are canonical term strings whose type is known only at run time. The other kinds are
native columns, so that scans of typed tables keep predicates and aggregates that Catalyst can push
down: ``iri`` (a column behind a fixed IRI prefix), ``int``, ``decimal``, ``double``, ``string``,
``bool`` and ``dateTime``. ``number`` is a computed number with its promotion rank in ``aux``; it exists only
within an expression. Integers and decimals are computed in ``exact``, a decimal(38,18), and only what
does not fit there in doubles. A null is an unbound variable or an expression error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T

NUMBER_KINDS = ("int", "decimal", "double")
EXACT = "decimal(38,18)"
DATATYPES = {"int": T.XSD + "integer", "decimal": T.XSD + "decimal", "double": T.XSD + "double", "string": T.STRING, "bool": T.XSD + "boolean", "dateTime": T.XSD + "dateTime"}
DATES = [T.XSD + "dateTime", T.XSD + "date"]


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column
    prefix: str = ""
    aux: Column | None = None
    exact: Column | None = None

    def rep(self) -> tuple[str, str]:
        return self.kind, self.prefix


def settled(v: Val) -> Val:
    """A value as it can be stored in a column: computed numbers become terms."""
    return Val("term", number_text(v.col, v.aux, v.exact)) if v.kind == "number" else v


def null() -> Val:
    return Val("term", F.lit(None).cast("string"))


def constant(term: str) -> Val:
    kind, text, _, datatype = T.parts(term)
    if kind == "L":
        try:
            if datatype in T.INTEGERS and datatype == T.XSD + "integer" and abs(int(text)) < 2**63:
                return Val("int", F.lit(int(text)).cast("bigint"))
            if datatype == T.XSD + "double":
                return Val("double", F.lit(float(text.replace("INF", "inf"))))
            if datatype == T.XSD + "decimal":
                return Val("decimal", F.lit(text).cast("decimal(38,18)"))
        except ValueError:
            pass
        if datatype == T.XSD + "boolean" and text in ("true", "false"):
            return Val("bool", F.lit(text == "true"))
        if datatype == T.STRING:
            return Val("string", F.lit(text))
    return Val("term", F.lit(term))


def decimal_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ".0")


def lex(v: Val) -> Column:
    """Lexical form (of an IRI the IRI, of a blank node its label)."""
    v = settled(v)
    c = v.col
    if v.kind == "term":
        return F.when(F.left(c, F.lit(1)).isin("I", "B", "S"), F.substr(c, F.lit(2))).otherwise(F.substr(c, F.instr(c, " ") + 1))
    if v.kind == "iri":
        return F.concat(F.lit(v.prefix), c.cast("string"))
    if v.kind == "dateTime":
        micros = F.when(F.date_format(c, "SSSSSS") != "000000", F.concat(F.lit("."), F.rtrim(F.date_format(c, "SSSSSS"), F.lit("0")))).otherwise("")
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), micros)
    if v.kind == "decimal":
        return decimal_text(c)
    return c.cast("string")


def term(v: Val) -> Column:
    v = settled(v)
    if v.kind == "term":
        return v.col
    if v.kind == "iri":
        return F.concat(F.lit("I" + v.prefix), v.col.cast("string"))
    if v.kind == "string":
        return F.concat(F.lit("S"), v.col)
    return F.concat(F.lit(f"T{DATATYPES[v.kind]} "), lex(v))


def kind_is(v: Val, letters: str) -> Column:
    v = settled(v)
    if v.kind == "term":
        return F.left(v.col, F.lit(1)).isin(*letters)
    own = "I" if v.kind == "iri" else "S" if v.kind == "string" else "T"
    return F.when(v.col.isNotNull(), F.lit(own in letters))


def datatype(v: Val) -> Column:
    """Datatype IRI as text; null for IRIs and blank nodes."""
    v = settled(v)
    c = v.col
    if v.kind == "term":
        first = F.left(c, F.lit(1))
        return F.when(first == "T", F.substr(c, F.lit(2), F.instr(c, " ") - 2)).when(first == "S", T.STRING).when(first == "G", T.LANG_STRING)
    return F.lit(None).cast("string") if v.kind == "iri" else F.when(c.isNotNull(), F.lit(DATATYPES[v.kind]))


def lang(v: Val) -> Column:
    """Language tag, '' for other literals, null for what is no literal."""
    v = settled(v)
    if v.kind == "term":
        first = F.left(v.col, F.lit(1))
        return F.when(first == "G", F.substr(v.col, F.lit(2), F.instr(v.col, " ") - 2)).when(first.isin("S", "T"), "")
    return F.lit(None).cast("string") if v.kind == "iri" else F.when(v.col.isNotNull(), "")


def num(v: Val) -> Column:
    """Numeric value as double, else null."""
    if v.kind == "number":
        return v.col
    if v.kind == "term":
        text = F.regexp_replace(lex(v), "INF$", "Infinity")
        return F.when(F.left(v.col, F.lit(1)) == "T", F.when(datatype(v).isin(*T.NUMERICS), text.try_cast("double")))
    return v.col.cast("double") if v.kind in NUMBER_KINDS else F.lit(None).cast("double")


def exact(v: Val) -> Column:
    """Integers and decimals as decimal(38,18), null for other values and for what does not fit."""
    none = F.lit(None).cast(EXACT)
    if v.kind == "number":
        return none if v.exact is None else v.exact
    if v.kind == "term":
        return F.when(datatype(v).isin(*T.INTEGERS, T.XSD + "decimal"), lex(v).try_cast(EXACT))
    return v.col.cast(EXACT) if v.kind in ("int", "decimal") else none


def both_exact(a: Val, b: Val) -> Column:
    return exact(a).isNotNull() & exact(b).isNotNull()


def rank(v: Val) -> Column:
    """Promotion rank of a numeric value."""
    if v.kind == "number":
        return v.aux
    if v.kind == "term":
        d = datatype(v)
        return F.when(d.isin(*T.INTEGERS), 0).when(d == T.XSD + "decimal", 1).when(d == T.XSD + "float", 2).when(d == T.XSD + "double", 3)
    return F.lit({"int": 0, "decimal": 1, "double": 3}.get(v.kind)).cast("int")


def number(value: Column, ranked: Column, precise: Column | None = None) -> Val:
    """A number of run-time rank from a double and its exact value; null where it has no rank."""
    return Val("number", F.when(ranked.isNotNull(), value), aux=ranked, exact=precise)


def number_text(value: Column, ranked: Column, precise: Column | None = None, integer: Column | None = None) -> Column:
    """The canonical term of a number and its rank; ``integer`` is an exact value that may be too large for ``precise``."""
    whole, part = value.try_cast("decimal(38,0)"), value.try_cast(EXACT)
    if precise is not None:
        whole, part = F.coalesce(precise.try_cast("decimal(38,0)") if integer is None else integer, whole), F.coalesce(precise, part)
    whole = F.concat(F.lit(f"T{T.XSD}integer "), whole.cast("string"))
    exact = F.concat(F.lit(f"T{T.XSD}decimal "), decimal_text(part))
    single = F.concat(F.lit(f"T{T.XSD}float "), value.cast("string"))
    return F.when(ranked == 0, whole).when(ranked == 1, exact).when(ranked == 2, single).when(ranked == 3, F.concat(F.lit(f"T{T.XSD}double "), value.cast("string")))


def moment(v: Val) -> Column:
    v = settled(v)
    if v.kind == "term":
        return F.when(datatype(v).isin(*DATES), lex(v).try_cast("timestamp"))
    return v.col if v.kind == "dateTime" else F.lit(None).cast("timestamp")


def truth(v: Val) -> Column:
    """xsd:boolean value, else null; lexical 1 and 0 count."""
    v = settled(v)
    if v.kind == "term":
        return F.when(datatype(v) == T.XSD + "boolean", F.when(lex(v).isin("true", "1"), True).when(lex(v).isin("false", "0"), False))
    return v.col if v.kind == "bool" else F.lit(None).cast("boolean")


def ebv(v: Val) -> Column:
    """Effective boolean value; null is an error."""
    if v.kind == "bool":
        return v.col
    if v.kind in (*NUMBER_KINDS, "number"):
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "string":
        return v.col != ""
    if v.kind != "term":
        return F.lit(None).cast("boolean")
    n = num(v)
    plain = F.when(kind_is(v, "SG"), lex(v) != "")
    return F.coalesce(truth(v), (n != 0) & ~F.isnan(n), plain, F.when(datatype(v).isin(T.XSD + "boolean", *T.NUMERICS), False))


def of_truth(c: Column) -> Val:
    return Val("bool", c)


def order_keys(v: Val) -> list[Column]:
    """Sort keys: unbound, blank nodes, IRIs, then literals, numbers and dates by value."""
    v = settled(v)
    if v.kind in (*NUMBER_KINDS, "string", "bool", "dateTime"):
        return [v.col]
    if v.kind == "iri":
        return [lex(v)]
    first = F.left(v.col, F.lit(1))
    number, when = num(v), moment(v)
    place = F.when(v.col.isNull(), 0).when(first == "B", 1).when(first == "I", 2).when(number.isNotNull(), 3).when(when.isNotNull(), 4).otherwise(5)
    return [place, number, exact(v), when, lex(v), v.col]


def order_struct(v: Val) -> Column:
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(order_keys(v))))


def numbers(a: Val, b: Val) -> bool:
    return a.kind in (*NUMBER_KINDS, "number") and b.kind in (*NUMBER_KINDS, "number")


def same_term(a: Val, b: Val) -> Column:
    if a.rep() == b.rep() and a.kind != "number":
        return a.col == b.col
    return term(a) == term(b)


def equal(a: Val, b: Val) -> Column:
    """RDFterm-equal: by value where both have one, an error for unlike literals of unknown types."""
    if numbers(a, b):
        return a.col == b.col if "number" not in (a.kind, b.kind) else F.when(both_exact(a, b), exact(a) == exact(b)).otherwise(num(a) == num(b))
    if a.rep() == b.rep() and a.kind != "term":
        return a.col == b.col
    if not {"term", "number"} & {a.kind, b.kind}:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    known = [*T.NUMERICS, *DATES, T.STRING, T.LANG_STRING, T.XSD + "boolean"]
    da, db = datatype(a), datatype(b)
    unlike = F.when(da.isNull() | db.isNull(), False).when(da.isin(*known) & db.isin(*known), False)
    tests = [F.when(x.isNotNull() & y.isNotNull(), x == y) for x, y in lanes(a, b)]
    by_value = F.coalesce(*tests) if tests else F.lit(None).cast("boolean")
    return F.coalesce(by_value, F.when(term(a) == term(b), True), F.when(a.col.isNotNull() & b.col.isNotNull(), unlike))


def less(a: Val, b: Val) -> Column:
    """a < b of comparable literals, else null."""
    if "number" not in (a.kind, b.kind) and (numbers(a, b) or a.rep() == b.rep() and a.kind in ("string", "dateTime", "bool")):
        return a.col < b.col
    tests = [x < y for x, y in lanes(a, b)]
    if {a.kind, b.kind} <= {"term", "string"}:
        tests.append(F.when(kind_is(a, "S") & kind_is(b, "S"), lex(a) < lex(b)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("boolean")


def lanes(a: Val, b: Val) -> list[tuple[Column, Column]]:
    """Pairs of comparable values, of the types that both may have; integers and decimals before doubles."""
    native = {a.kind, b.kind} - {"term"}
    out = []
    if native <= {*NUMBER_KINDS, "number"}:
        if "double" not in native:
            out.append((exact(a), exact(b)))
        out.append((num(a), num(b)))
    if native <= {"dateTime"}:
        out.append((moment(a), moment(b)))
    if native <= {"bool"}:
        out.append((truth(a), truth(b)))
    return out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions) if conditions else F.lit(True)
