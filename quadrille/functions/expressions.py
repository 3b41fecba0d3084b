"""SPARQL expressions to values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import algebra as A
from . import terms as T
from . import values as V
from .values import Val

#: Extension functions: IRI -> f(compiler, argument expressions) -> Val.
EXTENSIONS: dict[str, Callable] = {}


def extension(iri: str):
    def register(f):
        EXTENSIONS[iri] = f
        return f

    return register


class Compiler:
    """Compiles expressions in a scope of variables; ``now`` is frozen for the query."""

    def __init__(self, scope: dict[str, Val], now: str = "1970-01-01T00:00:00Z", base: str = "", flags: dict | None = None, engine=None):
        self.scope, self.now, self.base, self.flags, self.engine = scope, now, base, flags or {}, engine

    def __call__(self, e) -> Val:
        match e:
            case A.Var(name):
                return self.scope.get(name) or V.null()
            case A.Term(text):
                return V.constant(text)
            case A.Exists():
                return V.of_truth(self.flags[id(e)])
            case A.Call(name, args):
                if name.startswith("I") and ":" in name:
                    return self.by_iri(name[1:], args)
                if name in OPERATORS:
                    return OPERATORS[name](self, *args)
                return FUNCTIONS[name](*map(self, args))
        raise ValueError(f"no expression: {e!r}")

    def condition(self, e) -> Column:
        """A filter's condition: errors drop the row."""
        return F.coalesce(V.ebv(self(e)), F.lit(False))

    def by_iri(self, iri: str, args) -> Val:
        if iri in EXTENSIONS:
            return EXTENSIONS[iri](self, args)
        if iri.startswith(T.XSD):
            return cast(iri, self(args[0]))
        raise ValueError(f"unknown function <{iri}>")


def text(c: Column) -> Val:
    return Val("string", c)


def like(source: Val, c: Column) -> Val:
    """A literal with the language and datatype of ``source`` and another text."""
    source = V.settled(source)
    if source.kind != "term":
        return text(c)
    head = F.when(F.left(source.col, F.lit(1)) == "G", F.left(source.col, F.instr(source.col, " "))).when(V.kind_is(source, "S"), "S")
    return Val("term", F.concat(head, c))


def string(v: Val) -> Column:
    """Text of a string literal (plain or with a language), else null."""
    return v.col if v.kind == "string" else F.when(V.kind_is(v, "SG"), V.lex(v))


def compatible(a: Val, b: Val) -> Column:
    """Argument compatibility: the second has no language or the first's."""
    if b.kind == "string":
        return F.lit(True)
    return (V.lang(b) == "") | (V.lang(a) == V.lang(b))


# operators
def _or(c, a, b):
    return V.of_truth(V.ebv(c(a)) | V.ebv(c(b)))


def _and(c, a, b):
    return V.of_truth(V.ebv(c(a)) & V.ebv(c(b)))


def _in(c, e, *items):
    if not items:
        return V.of_truth(F.lit(False))
    v = c(e)
    out = V.equal(v, c(items[0]))
    for i in items[1:]:
        out = out | V.equal(v, c(i))
    return V.of_truth(out)


def _if(c, test, a, b):
    x, y = c(a), c(b)
    t = V.ebv(c(test))
    if x.rep() == y.rep() and x.kind != "number":
        return Val(x.kind, F.when(t, x.col).when(~t, y.col), x.prefix)
    return Val("term", F.when(t, V.term(x)).when(~t, V.term(y)))


def _coalesce(c, *args):
    vals = [c(a) for a in args]
    if not vals:
        return V.null()
    if len({v.rep() for v in vals}) == 1 and vals[0].kind != "number":
        return Val(vals[0].kind, F.coalesce(*(v.col for v in vals)), vals[0].prefix)
    return Val("term", F.coalesce(*map(V.term, vals)))


def _bound(c, var):
    return V.of_truth(c(var).col.isNotNull())


def _arithmetic(name: str):
    safe = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[name]

    def build(c, a, b):
        x, y = c(a), c(b)
        kinds = {x.kind, y.kind}
        if kinds == {"int"}:
            if name == "/":
                return Val("decimal", F.try_divide(x.col.cast("decimal(20,0)"), y.col.cast("decimal(20,0)")).cast("decimal(38,18)"))
            return Val("int", safe(x.col, y.col))
        if kinds <= set(V.NUMBER_KINDS):
            if "double" in kinds:
                return Val("double", safe(x.col.cast("double"), y.col.cast("double")))
            return Val("decimal", _precise(name, V.exact(x), V.exact(y)))
        ranked = F.greatest(V.rank(x), V.rank(y))
        both = V.num(x).isNotNull() & V.num(y).isNotNull()
        if name == "/":
            quotient = F.try_divide(V.num(x), V.num(y))
            loose = V.num(x) / F.nullif(V.num(y), F.lit(0.0))
            return V.number(F.when(both, F.when(ranked >= 2, loose).otherwise(quotient)), F.greatest(ranked, F.lit(1)), _precise(name, V.exact(x), V.exact(y)))
        return V.number(F.when(both, safe(V.num(x), V.num(y))), ranked, _precise(name, V.exact(x), V.exact(y)))

    return build


def _precise(name: str, x: Column, y: Column) -> Column:
    """Exact arithmetic on decimal(38,18). Products and quotients keep their digits where both operands
    have at most 9 on either side of the point, or are whole; others go through doubles."""
    safe = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[name]
    if name in "+-":
        return safe(x, y).try_cast(V.EXACT)
    wide = safe(x.cast("double"), y.cast("double")).try_cast(V.EXACT)
    for kind in ("decimal(20,0)", "decimal(19,9)"):
        a, b = x.try_cast(kind), y.try_cast(kind)
        wide = F.when((a == x) & (b == y), safe(a, b).try_cast(V.EXACT)).otherwise(wide)
    return wide


def _negative(c, a):
    return OPERATORS["*"](c, A.Term(T.integer(-1)), a)


def _lang_matches(tag: Val, pattern: Val) -> Val:
    t, p = F.lower(string(tag)), F.lower(string(pattern))
    return V.of_truth(F.when(p == "*", t != "").otherwise((t == p) | F.startswith(t, F.concat(p, F.lit("-")))))


OPERATORS: dict[str, Callable] = {
    "||": _or,
    "&&": _and,
    "!": lambda c, a: V.of_truth(~V.ebv(c(a))),
    "=": lambda c, a, b: V.of_truth(V.equal(c(a), c(b))),
    "!=": lambda c, a, b: V.of_truth(~V.equal(c(a), c(b))),
    "<": lambda c, a, b: V.of_truth(V.less(c(a), c(b))),
    ">": lambda c, a, b: V.of_truth(V.less(c(b), c(a))),
    "<=": lambda c, a, b: V.of_truth(V.less(c(a), c(b)) | V.equal(c(a), c(b))),
    ">=": lambda c, a, b: V.of_truth(V.less(c(b), c(a)) | V.equal(c(a), c(b))),
    "IN": _in,
    "IF": _if,
    "COALESCE": _coalesce,
    "BOUND": _bound,
    "neg": _negative,
    "NOW": lambda c: Val("term", F.lit(T.literal(c.now, T.XSD + "dateTime"))),
    "IRI": lambda c, a: _iri(c, c(a)),
    **{op: _arithmetic(op) for op in "+-*/"},
}


def _iri(c: Compiler, v: Val) -> Val:
    given = F.when(V.kind_is(v, "IS"), V.lex(v))
    if c.base:
        absolute = given.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
        given = F.when(absolute, given).otherwise(F.concat(F.lit(c.base.rsplit("/", 1)[0] + "/"), given))
    return Val("iri", given)


# functions
def _round(f):
    def of_double(c: Column) -> Column:
        # doubles of 2^53 and more, infinities among them, are whole; Spark rounds to a bigint
        return F.when(F.isnan(c) | (F.abs(c) >= float(2**53)), c).otherwise(f(c).cast("double"))

    def build(v: Val) -> Val:
        if v.kind == "int":
            return v
        if v.kind == "decimal":
            return Val("decimal", f(v.col.cast(V.EXACT)).try_cast(V.EXACT))
        if v.kind == "double":
            return Val("double", of_double(v.col))
        return V.number(of_double(V.num(v)), V.rank(v), f(V.exact(v)).try_cast(V.EXACT))

    return build


def _regex_flags(flags: Val | None) -> str | Column:
    return F.lit("") if flags is None else F.when(F.length(string(flags)) > 0, F.concat(F.lit("(?"), F.regexp_replace(string(flags), "[^ismx]", ""), F.lit(")"))).otherwise("")


def _regex(v: Val, pattern: Val, flags: Val | None = None) -> Val:
    return V.of_truth(F.rlike(string(v), F.concat(_regex_flags(flags), string(pattern))))


def _replace(v: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    return like(v, F.regexp_replace(string(v), F.concat(_regex_flags(flags), string(pattern)), string(by)))


def _substr(v: Val, start: Val, length: Val | None = None) -> Val:
    s = string(v)
    begin = F.floor(V.num(start) + 0.5).cast("int")
    if length is None:
        return like(v, F.substr(s, F.greatest(begin, F.lit(1))))
    end = begin + F.floor(V.num(length) + 0.5).cast("int")
    first = F.greatest(begin, F.lit(1))
    return like(v, F.substr(s, first, F.greatest(end - first, F.lit(0))))


def _before(v: Val, part: Val) -> Val:
    s, p = string(v), string(part)
    at = F.when(p == "", 1).otherwise(F.instr(s, p))
    found = like(v, F.left(s, at - 1))
    return Val("term", F.when(compatible(v, part), F.when(at > 0, V.term(found)).otherwise("S")))


def _after(v: Val, part: Val) -> Val:
    s, p = string(v), string(part)
    at = F.when(p == "", 1).otherwise(F.instr(s, p))
    found = like(v, F.substr(s, at + F.length(p)))
    return Val("term", F.when(compatible(v, part), F.when(at > 0, V.term(found)).otherwise("S")))


def _concat(*vals: Val) -> Val:
    if not vals:
        return text(F.lit(""))
    joined = F.concat(*map(string, vals))
    if all(v.kind == "string" for v in vals):
        return text(joined)
    tags = [V.lang(v) for v in vals]
    shared = V.all_of([t == tags[0] for t in tags]) & (tags[0] != "")
    return Val("term", F.when(shared, F.concat(F.lit("G"), tags[0], F.lit(" "), joined)).otherwise(F.concat(F.lit("S"), joined)))


def _encode(v: Val) -> Val:
    c = F.url_encode(string(v))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return text(c)


def _date_part(pattern: str, kind: str = "int"):
    def build(v: Val) -> Val:
        found = F.when(F.lit(v.kind == "dateTime") | V.datatype(v).isin(*V.DATES), F.regexp_extract(V.lex(v), pattern, 1))
        return Val("int", found.try_cast("bigint")) if kind == "int" else Val("decimal", found.try_cast("decimal(38,18)"))

    return build


def _zone(v: Val) -> Column:
    return F.when(F.lit(v.kind == "dateTime") | V.datatype(v).isin(*V.DATES), F.regexp_extract(V.lex(v), r"(Z|[+-]\d\d:\d\d)$", 1))


def _timezone(v: Val) -> Val:
    z = _zone(v)
    hours, minutes = F.substr(z, F.lit(2), F.lit(2)).try_cast("int"), F.substr(z, F.lit(5), F.lit(2)).try_cast("int")
    body = F.concat(F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    zero = (z == "Z") | ((hours == 0) & (minutes == 0))
    shown = F.when(zero, "PT0S").when(F.startswith(z, F.lit("-")), F.concat(F.lit("-"), body)).when(z != "", body)
    return Val("term", F.concat(F.lit(f"T{T.XSD}dayTimeDuration "), shown))


def _strdt(v: Val, kind: Val) -> Val:
    made = F.concat(F.lit("T"), V.lex(kind), F.lit(" "), string(v))
    plain = V.kind_is(v, "S")
    return Val("term", F.when(plain, F.when(V.lex(kind) == T.STRING, F.concat(F.lit("S"), string(v))).otherwise(made)))


def _strlang(v: Val, tag: Val) -> Val:
    return Val("term", F.when(V.kind_is(v, "S"), F.concat(F.lit("G"), F.lower(string(tag)), F.lit(" "), string(v))))


def _bnode(v: Val | None = None) -> Val:
    return Val("term", F.concat(F.lit("B"), F.uuid() if v is None else F.concat(F.lit("l"), F.md5(V.lex(v)))))


def cast(to: str, v: Val) -> Val:
    s, name = F.trim(V.lex(v)), to.removeprefix(T.XSD)
    literal = ~V.kind_is(v, "IB")
    if name == "string":
        return text(F.when(~V.kind_is(v, "B"), V.lex(v)))
    if name in ("double", "float", "decimal", "integer", "int", "long"):
        n = F.coalesce(V.num(v), V.truth(v).cast("double"))
        parsed = F.when(literal & s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$" if name in ("double", "float") else r"^[+-]?(\d+(\.\d*)?|\.\d+)$" if name == "decimal" else r"^[+-]?\d+$"), s.try_cast("double"))
        n = F.coalesce(n, F.when(V.datatype(v) == T.STRING, parsed))
        if name in ("integer", "int", "long"):
            whole = F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")), n.try_cast("bigint"))
            return Val("int", F.when(n.isNotNull(), whole))
        if name == "float":
            return V.number(n, F.lit(2))
        return Val("double", n) if name == "double" else Val("decimal", n.try_cast("decimal(38,18)"))
    if name == "boolean":
        return V.of_truth(F.coalesce(V.truth(v), (V.num(v) != 0) & ~F.isnan(V.num(v)), F.when(V.datatype(v) == T.STRING, F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False))))
    if name in ("dateTime", "date"):
        ok = s.rlike(r"^-?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$") & literal
        shown = F.when(F.lit(name == "date"), F.left(s, F.lit(10))).otherwise(F.when(s.contains("T"), s).otherwise(F.concat(s, F.lit("T00:00:00"))))
        return Val("term", F.when(ok, F.concat(F.lit(f"T{to} "), shown)))
    raise ValueError(f"no cast to <{to}>")


FUNCTIONS: dict[str, Callable] = {
    "STR": lambda v: text(F.when(~V.kind_is(v, "B"), V.lex(v))),
    "LANG": lambda v: text(V.lang(v)),
    "LANGMATCHES": _lang_matches,
    "DATATYPE": lambda v: Val("iri", V.datatype(v)),
    "BNODE": _bnode,
    "RAND": lambda: Val("double", F.rand()),
    "ABS": lambda v: Val("int", F.abs(v.col)) if v.kind == "int" else _round(F.abs)(v),
    "CEIL": _round(F.ceil),
    "FLOOR": _round(F.floor),
    "ROUND": _round(lambda c: F.floor(c + F.lit("0.5").cast("decimal(2,1)"))),
    "CONCAT": _concat,
    "STRLEN": lambda v: Val("int", F.length(string(v)).cast("bigint")),
    "UCASE": lambda v: like(v, F.upper(string(v))),
    "LCASE": lambda v: like(v, F.lower(string(v))),
    "ENCODE_FOR_URI": _encode,
    "CONTAINS": lambda a, b: V.of_truth(F.when(compatible(a, b), F.contains(string(a), string(b)))),
    "STRSTARTS": lambda a, b: V.of_truth(F.when(compatible(a, b), F.startswith(string(a), string(b)))),
    "STRENDS": lambda a, b: V.of_truth(F.when(compatible(a, b), F.endswith(string(a), string(b)))),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "SUBSTR": _substr,
    "REPLACE": _replace,
    "REGEX": _regex,
    "YEAR": _date_part(r"^(-?\d{4,})-"),
    "MONTH": _date_part(r"^-?\d{4,}-(\d\d)"),
    "DAY": _date_part(r"^-?\d{4,}-\d\d-(\d\d)"),
    "HOURS": _date_part(r"T(\d\d):"),
    "MINUTES": _date_part(r"T\d\d:(\d\d)"),
    "SECONDS": _date_part(r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", "decimal"),
    "TZ": lambda v: text(_zone(v)),
    "TIMEZONE": _timezone,
    "UUID": lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: text(F.uuid()),
    "MD5": lambda v: text(F.md5(string(v))),
    "SHA1": lambda v: text(F.sha1(string(v))),
    "SHA256": lambda v: text(F.sha2(string(v), 256)),
    "SHA384": lambda v: text(F.sha2(string(v), 384)),
    "SHA512": lambda v: text(F.sha2(string(v), 512)),
    "STRDT": _strdt,
    "STRLANG": _strlang,
    "SAMETERM": lambda a, b: V.of_truth(V.same_term(a, b)),
    "ISIRI": lambda v: V.of_truth(V.kind_is(v, "I")),
    "ISBLANK": lambda v: V.of_truth(V.kind_is(v, "B")),
    "ISLITERAL": lambda v: V.of_truth(V.kind_is(v, "SGT")),
    "ISNUMERIC": lambda v: V.of_truth(F.when(v.col.isNotNull(), V.num(v).isNotNull())),
}
