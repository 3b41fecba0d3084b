"""SPARQL 1.1 query and update: text to algebra."""

from __future__ import annotations

import re
from functools import reduce
from itertools import count
from urllib.parse import urljoin

from ..functions import terms as T
from . import algebra as A


class ParseError(ValueError):
    pass


_PN = r"[A-Za-z_\u00C0-\uFFFD\U00010000-\U000EFFFF][\w.\-\u00B7\u00C0-\uFFFD\U00010000-\U000EFFFF]*"
_TOKENS = re.compile(
    r"""
    (?P<space>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<double>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
  | (?P<decimal>\d*\.\d+)
  | (?P<integer>\d+)
  | (?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)
  | (?P<pname>(?:PN)?:(?:(?:[\w:\u00C0-\uFFFD]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-\u00B7\u00C0-\uFFFD]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-\u00C0-\uFFFD]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z_][\w]*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\],;.=<>!+\-*/|^?&])
    """.replace("PN", _PN.replace("*", "*?")),
    re.VERBOSE,
)
_ESC = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
# Function and aggregate names of the language.
BUILTINS = set(
    "STR LANG LANGMATCHES DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512 COALESCE IF STRLANG STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE".split()
)
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        return _ESC[c] if c in _ESC else chr(int(c[1:], 16))

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = "", aliases: dict[str, str] | None = None):
        self.aliases = aliases or {}
        text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m.group(1) or m.group(2), 16)), text)
        self.prefixes, self.base, self.fresh, self.labels = dict(prefixes or {}), base, count(), {}
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0
        self.aggregates: list | None = None

    # token handling
    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def at(self, *words: str) -> bool:
        k, v = self.tokens[self.i]
        return (k == "word" and v.upper() in words) or (k == "op" and v in words)

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ParseError(f"expected {word} before {self.value!r}")

    # prologue and entry points
    def prologue(self) -> None:
        while True:
            if self.take("BASE"):
                self.base = urljoin(self.base, self.next()[1:-1])
            elif self.take("PREFIX"):
                name = self.next()
                if not name.endswith(":"):
                    raise ParseError(f"bad prefix {name!r}")
                self.prefixes[name[:-1]] = urljoin(self.base, self.next()[1:-1])
            else:
                return

    def query(self) -> A.Query:
        self.prologue()
        if self.at("SELECT"):
            q = self.select_query()
        elif self.take("ASK"):
            q = A.Query("ask", None)
            self.dataset(q)
            q.pattern = self.where()
            q.pattern = self.modifiers(q.pattern, None)[0]
        elif self.take("CONSTRUCT"):
            q = A.Query("construct", None)
            if self.at("{"):
                q.template = self.template()
                self.dataset(q)
                q.pattern = self.where()
            else:
                self.dataset(q)
                self.need("WHERE")
                q.template = self.template()
                q.pattern = A.BGP([A.Triple(*t[:3]) for t in q.template])
            q.pattern = self.modifiers(q.pattern, None)[0]
        elif self.take("DESCRIBE"):
            q = A.Query("describe", None)
            if not self.take("*"):
                while self.kind in ("var", "iri", "pname"):
                    q.targets.append(self.var_or_term())
            self.dataset(q)
            q.pattern = self.where() if self.at("WHERE", "{") else A.BGP([])
            q.targets = q.targets or [A.Var(n) for n in A.in_scope(q.pattern)]
            q.pattern = self.modifiers(q.pattern, None)[0]
        else:
            raise ParseError(f"unknown query form {self.value!r}")
        if self.take("VALUES"):
            q.pattern = self._with_values(q.pattern, self.data_block())
        if self.kind != "end":
            raise ParseError(f"text after the query: {self.value!r}")
        return q

    @staticmethod
    def _with_values(pattern, values):
        """Trailing VALUES joins with what grouping gives, below expressions that do not bind its names."""
        spine, node = [], pattern
        while isinstance(node, A.Slice | A.Distinct | A.Project | A.OrderBy) or (isinstance(node, A.Extend) and node.var not in values.names):
            spine.append(node)
            node = node.child
        joined = A.Join(node, values)
        if not spine:
            return joined
        spine[-1].child = joined
        return pattern

    def dataset(self, q: A.Query) -> None:
        while self.take("FROM"):
            (q.from_named if self.take("NAMED") else q.from_graphs).append(self.iri_ref())

    def where(self):
        self.take("WHERE")
        return self.group_pattern()

    def select_query(self) -> A.Query:
        q = A.Query("select", None)
        pattern, names = self.select_body(q)
        q.pattern, q.names = pattern, names
        return q

    def select_body(self, q: A.Query | None = None):
        self.need("SELECT")
        distinct = self.take("DISTINCT") or self.take("REDUCED")
        outer, self.aggregates = self.aggregates, []
        items: list = []
        star = self.take("*")
        while not star and (self.kind == "var" or self.at("(")):
            if self.kind == "var":
                items.append((self.next()[1:], None))
            else:
                self.need("(")
                e = self.expression()
                self.need("AS")
                items.append((self.next()[1:], e))
                self.need(")")
        if q is not None:
            self.dataset(q)
        body = self.where()
        pattern, names = self.modifiers(body, None if star else items, distinct)
        if self.at("VALUES") and q is None:
            self.next()
            pattern = self._with_values(pattern, self.data_block())
        self.aggregates = outer
        return pattern, names

    def modifiers(self, body, items, distinct: bool = False):
        found = self.aggregates if self.aggregates is not None else []
        self.aggregates = found
        keys: list | None = None
        if self.take("GROUP"):
            self.need("BY")
            keys = []
            while self.kind in ("var", "iri", "pname") or self.at("(") or (self.kind == "word" and self.value.upper() in BUILTINS):
                if self.kind == "var":
                    name = self.next()[1:]
                    keys.append((name, A.Var(name)))
                elif self.take("("):
                    e = self.expression()
                    name = self.next()[1:] if self.take("AS") else f".key{next(self.fresh)}"
                    self.need(")")
                    keys.append((name, e))
                else:
                    keys.append((f".key{next(self.fresh)}", self.primary()))
        having = []
        if self.take("HAVING"):
            having.append(self.constraint())
            while self.at("(") or self.kind in ("iri", "pname") or (self.kind == "word" and self.value.upper() in BUILTINS):
                having.append(self.constraint())
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if self.at("ASC", "DESC"):
                    up = self.next().upper() == "ASC"
                    self.need("(")
                    order.append((self.expression(), up))
                    self.need(")")
                elif self.kind == "var":
                    order.append((A.Var(self.next()[1:]), True))
                elif self.at("(") or self.kind in ("iri", "pname") or (self.kind == "word" and self.value.upper() in BUILTINS):
                    order.append((self.constraint(), True))
                else:
                    break
        limit, offset = None, 0
        while self.at("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                limit = int(self.next())
            else:
                self.next()
                offset = int(self.next())
        if keys is not None or found:
            body = A.Group(body, keys or [], found)
            self.aggregates = []
        for e in having:
            body = A.Filter(body, e)
        names = None
        if items is not None:
            seen: set[str] = set()
            for name, e in items:
                if name in seen or (e is not None and not isinstance(body, A.Group) and name in A.in_scope(body)):
                    raise ParseError(f"?{name} is already bound")
                seen.add(name)
                if e is not None:
                    body = A.Extend(body, name, e)
            names = [n for n, _ in items]
        elif isinstance(body, A.Group):
            raise ParseError("SELECT * with grouping")
        else:
            names = A.in_scope(body)
        if order:
            body = A.OrderBy(body, order)
        if items is not None or distinct:
            body = A.Project(body, names)
        if distinct:
            body = A.Distinct(body)
        if limit is not None or offset:
            body = A.Slice(body, offset, limit)
        return body, names

    # graph patterns
    def group_pattern(self):
        pattern, condition = self.group_parts()
        return pattern if condition is None else A.Filter(pattern, condition)

    def group_parts(self):
        """A group's pattern and its own filters joined by ``&&``, None without any."""
        self.need("{")
        if self.at("SELECT"):
            pattern, _ = self.select_body()
            self.need("}")
            return pattern, None
        current, filters = A.BGP([]), []
        while not self.take("}"):
            if self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("OPTIONAL"):
                current = A.LeftJoin(current, *self.group_parts())
            elif self.take("MINUS"):
                current = A.Minus(current, self.group_pattern())
            elif self.take("GRAPH"):
                name = self.var_or_term()
                current = self._join(current, A.Graph(name, self.group_pattern()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                name = self.next()[1:]
                self.need(")")
                if name in A.in_scope(current):
                    raise ParseError(f"?{name} is already bound")
                current = A.Extend(current, name, e)
            elif self.take("VALUES"):
                current = self._join(current, self.data_block())
            elif self.at("{"):
                part = self.group_pattern()
                while self.take("UNION"):
                    part = A.Union(part, self.group_pattern())
                current = self._join(current, part)
            elif self.at("SERVICE"):
                raise ParseError("SERVICE is not supported")
            elif self.take("."):
                continue
            else:
                for item in self.triples_block():
                    current = self._join(current, item)
        return current, reduce(lambda a, b: A.Call("&&", (a, b)), filters) if filters else None

    @staticmethod
    def _join(left, right):
        if isinstance(left, A.BGP) and isinstance(right, A.BGP):
            return A.BGP(left.triples + right.triples)
        if isinstance(left, A.BGP) and not left.triples:
            return right
        if isinstance(left, A.Join) and isinstance(left.right, A.BGP) and isinstance(right, A.BGP):
            return A.Join(left.left, A.BGP(left.right.triples + right.triples))
        return A.Join(left, right)

    def data_block(self) -> A.Values:
        if self.kind == "var":
            names, rows = [self.next()[1:]], []
            self.need("{")
            while not self.take("}"):
                rows.append([self.data_value()])
            return A.Values(names, rows)
        self.need("(")
        names, rows = [], []
        while not self.take(")"):
            names.append(self.next()[1:])
        self.need("{")
        while not self.take("}"):
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(self.data_value())
            if len(row) != len(names):
                raise ParseError("VALUES row of another width")
            rows.append(row)
        return A.Values(names, rows)

    def data_value(self) -> str | None:
        return None if self.take("UNDEF") else self.var_or_term().text

    def triples_block(self) -> list:
        """Patterns of triples up to the next dot or element."""
        plain: list[A.Triple] = []
        out: list = []

        def emit(s, p, o):
            if isinstance(p, A.Var | A.Term):
                plain.append(A.Triple(s, p, o))
            else:
                out.append(A.PathPattern(s, p, o))

        self.subject_triples(emit, paths=True)
        return ([A.BGP(plain)] if plain else []) + out

    def subject_triples(self, emit, paths: bool) -> None:
        bracketed = self.at("[", "(")
        s = self.node(emit, paths)
        if bracketed and (self.at(".", "}") or self.kind == "end"):
            return
        self.property_list(s, emit, paths)

    def property_list(self, s, emit, paths: bool) -> None:
        while True:
            if self.kind == "var":
                p = A.Var(self.next()[1:])
            elif paths:
                path = self.path()
                p = A.Term(T.iri(path.iri)) if isinstance(path, A.Link) else path
            else:
                p = A.Term(T.iri(T.RDF_TYPE)) if self.take_a() else self.var_or_term()
            while True:
                emit(s, p, self.node(emit, paths))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.at(".", "}", "]") or self.kind == "end":
                return

    def take_a(self) -> bool:
        if self.kind == "word" and self.value == "a":
            self.i += 1
            return True
        return False

    def fresh_node(self):
        return A.Var(f"_:b{next(self.fresh)}")

    def node(self, emit, paths: bool):
        if self.take("["):
            s = self.fresh_node()
            if not self.take("]"):
                self.property_list(s, emit, paths)
                self.need("]")
            return s
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(emit, paths))
            tail = A.Term(T.iri(T.RDF + "nil"))
            for item in reversed(items):
                cell = self.fresh_node()
                emit(cell, A.Term(T.iri(T.RDF + "first")), item)
                emit(cell, A.Term(T.iri(T.RDF + "rest")), tail)
                tail = cell
            return tail
        return self.var_or_term()

    # property paths
    def path(self):
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.Alt(tuple(parts))

    def path_sequence(self):
        parts = [self.path_element()]
        while self.take("/"):
            parts.append(self.path_element())
        return parts[0] if len(parts) == 1 else A.Seq(tuple(parts))

    def path_element(self):
        inverse = self.take("^")
        p = self.path_primary()
        if self.take("*"):
            p = A.Repeat(p, 0, None)
        elif self.take("+"):
            p = A.Repeat(p, 1, None)
        elif self.take("?"):
            p = A.Repeat(p, 0, 1)
        elif self.at("{") and self.tokens[self.i + 1][0] in ("integer",) or (self.at("{") and self.tokens[self.i + 1][1] == ","):
            self.next()
            low = int(self.next()) if self.kind == "integer" else 0
            high: int | None = low
            if self.take(","):
                high = int(self.next()) if self.kind == "integer" else None
            self.need("}")
            p = A.Repeat(p, low, high)
        return A.Inverse(p) if inverse else p

    def path_primary(self):
        if self.take("("):
            p = self.path()
            self.need(")")
            return p
        if self.take("!"):
            forward, inverse = [], []
            items = [self.negated_item()]
            if items[0] is None:
                items = [] if self.take(")") else [self.negated_item(True)]
                while items and self.take("|"):
                    items.append(self.negated_item(True))
                if items:
                    self.need(")")
            for back, i in items:
                (inverse if back else forward).append(i)
            return A.NotIn(tuple(forward), tuple(inverse))
        if self.take_a():
            return A.Link(T.RDF_TYPE)
        return A.Link(self.iri_ref())

    def negated_item(self, inside: bool = False):
        if not inside and self.take("("):
            return None
        back = self.take("^")
        return back, T.RDF_TYPE if self.take_a() else self.iri_ref()

    # terms
    def iri_ref(self) -> str:
        found = self._iri_ref()
        for old, new in self.aliases.items():
            if found.startswith(old):
                return new + found[len(old) :]
        return found

    def _iri_ref(self) -> str:
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind == "iri":
            return urljoin(self.base, value[1:-1]) if self.base else value[1:-1]
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ParseError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ParseError(f"expected an IRI, not {value!r}")

    def var_or_term(self):
        kind, value = self.tokens[self.i]
        if kind == "var":
            self.i += 1
            return A.Var(value[1:])
        if kind in ("iri", "pname"):
            return A.Term(T.iri(self.iri_ref()))
        if kind == "blank":
            self.i += 1
            return A.Var(value)
        return A.Term(self.literal())

    def literal(self) -> str:
        sign = self.next() if self.at("+", "-") else ""
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind in ("integer", "decimal", "double"):
            return T.literal(("-" if sign == "-" else "") + value, T.XSD + kind)
        if kind == "word" and value.lower() in ("true", "false"):
            return T.boolean(value.lower() == "true")
        if kind in ("string", "long"):
            text = unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.kind == "lang":
                return T.literal(text, lang=self.next()[1:])
            if self.take("^^"):
                return T.literal(text, self.iri_ref())
            return T.literal(text)
        raise ParseError(f"expected a term, not {value!r}")

    # expressions
    def constraint(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        e = self.conjunction()
        while self.take("||"):
            e = A.Call("||", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.relation()
        while self.take("&&"):
            e = A.Call("&&", (e, self.relation()))
        return e

    def relation(self):
        e = self.sum()
        if self.at("=", "!=", "<", ">", "<=", ">="):
            return A.Call(self.next(), (e, self.sum()))
        if self.take("IN"):
            return A.Call("IN", (e, *self.arguments()))
        if self.at("NOT"):
            self.next()
            self.need("IN")
            return A.Call("!", (A.Call("IN", (e, *self.arguments())),))
        return e

    def sum(self):
        e = self.product()
        while self.at("+", "-"):
            e = A.Call(self.next(), (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while self.at("*", "/"):
            e = A.Call(self.next(), (e, self.unary()))
        return e

    def unary(self):
        if self.take("!"):
            return A.Call("!", (self.unary(),))
        if self.take("-"):
            if self.kind in ("integer", "decimal", "double"):
                datatype = T.XSD + self.kind
                return A.Term(T.literal("-" + self.next(), datatype))
            return A.Call("neg", (self.unary(),))
        self.take("+")
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out: list = []
        self.take("DISTINCT")
        while not self.take(")"):
            # parenthesised argument lists of search functions are flattened
            if self.at("(") and out and self._is_tuple():
                out.append(A.Call("tuple", self.arguments()))
            else:
                out.append(self.expression())
            self.take(",")
        return tuple(out)

    def _is_tuple(self) -> bool:
        depth, i = 0, self.i
        while i < len(self.tokens):
            v = self.tokens[i][1] if self.tokens[i][0] == "op" else ""
            depth += (v == "(") - (v == ")")
            if v == "," and depth == 1:
                return True
            if depth == 0:
                return False
            i += 1
        return False

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        kind, value = self.tokens[self.i]
        if kind == "var":
            self.i += 1
            return A.Var(value[1:])
        if kind in ("iri", "pname"):
            name = self.iri_ref()
            return A.Call("I" + name, self.arguments()) if self.at("(") else A.Term(T.iri(name))
        if kind == "word":
            word = value.upper()
            if word == "NOT":
                self.i += 1
                self.need("EXISTS")
                return A.Exists(self.inner_group(), True)
            if word == "EXISTS":
                self.i += 1
                return A.Exists(self.inner_group(), False)
            if word in AGGREGATES:
                return self.aggregate(word)
            if word in BUILTINS:
                self.i += 1
                return A.Call({"URI": "IRI", "ISURI": "ISIRI"}.get(word, word), self.arguments())
        return A.Term(self.literal())

    def inner_group(self):
        outer, self.aggregates = self.aggregates, None
        pattern = self.group_pattern()
        self.aggregates = outer
        return pattern

    def aggregate(self, word: str):
        self.i += 1
        self.need("(")
        distinct = self.take("DISTINCT")
        arg = None if self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = T.parts(self.literal())[1]
        self.need(")")
        if self.aggregates is None:
            raise ParseError(f"{word} outside of a projection")
        found = A.Aggregate(word, arg, distinct, separator)
        for name, other in self.aggregates:
            if other == found:
                return A.Var(name)
        name = f".agg{next(self.fresh)}"
        self.aggregates.append((name, found))
        return A.Var(name)

    # templates and updates
    def template(self, graph=None) -> list:
        self.need("{")
        out: list = []

        def emit(s, p, o):
            out.append((s, p, o, graph))

        while not self.take("}"):
            if self.take("."):
                continue
            if graph is None and self.take("GRAPH"):
                out.extend(self.template(self.var_or_term()))
                continue
            self.subject_triples(emit, paths=False)
        return out

    def update(self) -> list[A.Update]:
        out = []
        self.prologue()
        while self.kind != "end":
            out.append(self.update_step())
            if not self.take(";"):
                break
            self.prologue()
        if self.kind != "end":
            raise ParseError(f"text after the update: {self.value!r}")
        return out

    def update_step(self) -> A.Update:
        if self.take("INSERT"):
            if self.take("DATA"):
                return A.Update("insert_data", insert=self.template())
            return self.modify(A.Update("modify", insert=self.template()), None)
        if self.take("DELETE"):
            if self.take("DATA"):
                return A.Update("delete_data", delete=self.template())
            if self.take("WHERE"):
                quads = self.template()
                return A.Update("modify", delete=quads, pattern=self.quads_pattern(quads))
            u = A.Update("modify", delete=self.template())
            if self.take("INSERT"):
                u.insert = self.template()
            return self.modify(u, None)
        if self.take("WITH"):
            graph = A.Term(T.iri(self.iri_ref()))
            u = A.Update("modify")
            if self.take("DELETE"):
                u.delete = self.template()
            if self.take("INSERT"):
                u.insert = self.template()
            return self.modify(u, graph)
        word = self.next().upper()
        silent = self.take("SILENT")
        if word in ("CLEAR", "DROP"):
            return A.Update("clear", target=self.graph_ref(), silent=silent)
        if word == "CREATE":
            self.need("GRAPH")
            return A.Update("create", target=self.iri_ref(), silent=silent)
        if word == "LOAD":
            source, target = self.iri_ref(), None
            if self.take("INTO"):
                self.need("GRAPH")
                target = self.iri_ref()
            return A.Update("load", source=source, target=target, silent=silent)
        if word in ("COPY", "MOVE", "ADD"):
            source = self.graph_ref()
            self.need("TO")
            return A.Update(word.lower(), source=source, target=self.graph_ref(), silent=silent)
        raise ParseError(f"unknown update {word}")

    def graph_ref(self) -> str:
        """An IRI, or DEFAULT, NAMED or ALL."""
        for word in ("DEFAULT", "NAMED", "ALL"):
            if self.take(word):
                return word
        self.take("GRAPH")
        return self.iri_ref()

    @staticmethod
    def quads_pattern(quads: list):
        pattern = None
        for s, p, o, g in quads:
            one = A.BGP([A.Triple(s, p, o)])
            one = one if g is None else A.Graph(g, one)
            pattern = one if pattern is None else Parser._join(pattern, one)
        return pattern or A.BGP([])

    def modify(self, u: A.Update, graph) -> A.Update:
        while self.take("USING"):
            (u.using_named if self.take("NAMED") else u.using).append(self.iri_ref())
        self.need("WHERE")
        u.pattern = self.group_pattern()
        if graph is not None:
            u.insert = [(s, p, o, g or graph) for s, p, o, g in u.insert]
            u.delete = [(s, p, o, g or graph) for s, p, o, g in u.delete]
            if not u.using and not u.using_named:
                u.within = T.parts(graph.text)[1]
        return u


def parse_query(text: str, prefixes: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> A.Query:
    return Parser(text, prefixes, aliases=aliases).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[A.Update]:
    return Parser(text, prefixes).update()
