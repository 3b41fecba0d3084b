"""RDF files: N-Triples and N-Quads line by line in the JVM, Turtle per file, JSON quads; and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .store import DEFAULT_GRAPH, QUAD_SCHEMA

FORMATS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "jsonl": "jsonl", "json": "jsonl", "parquet": "parquet"}
_NODE = r"(<[^>]*>|_:\S+)"
# a literal ends at the line's last quote, as a graph holds none: no loop that long texts could overflow
_OBJECT = r'(<[^>]*>|_:\S+|".*"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_NODE}\s+(<[^>]*>)\s+{_OBJECT}\s*(?:{_NODE}\s*)?\.\s*(?:#[^\"]*)?$"


def detect_format(path: str, sample: str = "") -> str:
    """Format by extension (compression suffixes aside), else by content."""
    name = re.sub(r"\.(gz|bz2|zst|xz)$", "", path.rstrip("/").lower())
    ext = name.rpartition(".")[2]
    if ext in FORMATS:
        return FORMATS[ext]
    first = next((x.strip() for x in sample.splitlines() if x.strip() and not x.strip().startswith("#")), "")
    if first.startswith("{"):
        return "jsonl"
    if first.lower().startswith(("@prefix", "@base", "prefix", "base")):
        return "turtle"
    m = re.match(_LINE, first)
    return ("nquads" if m and m.group(4) else "ntriples") if m else "turtle"


def unescaped(c: Column) -> Column:
    """String escapes of N-Triples, in the JVM; backslashes are set aside first."""
    mark = ""
    out = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for old, new in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\b", "\b"), ("\\f", "\f")):
        out = F.replace(out, F.lit(old), F.lit(new))
    # \uXXXX: decode each escape where there is any
    coded = F.transform(F.split(out, r"(?=\\u[0-9A-Fa-f]{4})"), lambda x: F.when(x.rlike(r"^\\u[0-9A-Fa-f]{4}"), F.concat(F.decode(F.unhex(F.substr(x, F.lit(3), F.lit(4))), "UTF-16BE"), F.substr(x, F.lit(7)))).otherwise(x))
    out = F.when(out.rlike(r"\\u[0-9A-Fa-f]{4}"), F.array_join(coded, "")).otherwise(out)
    return F.replace(out, F.lit(mark), F.lit("\\"))


def canonical(c: Column) -> Column:
    """N-Triples term text to the canonical form."""
    body = unescaped(F.regexp_extract(c, r'(?s)^"(.*)"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?$', 1))
    tag, kind = F.lower(F.regexp_extract(c, r'"@([A-Za-z0-9\-]+)$', 1)), F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1)
    literal = F.when(tag != "", F.concat(F.lit("G"), tag, F.lit(" "), body)).when((kind != "") & (kind != T.STRING), F.concat(F.lit("T"), kind, F.lit(" "), body)).otherwise(F.concat(F.lit("S"), body))
    return F.when(c.startswith("<"), F.concat(F.lit("I"), F.substr(c, F.lit(2), F.length(c) - 2))).when(c.startswith("_:"), F.concat(F.lit("B"), F.substr(c, F.lit(3)))).when(c.startswith('"'), literal)


def parse_lines(lines: DataFrame, graph: str = DEFAULT_GRAPH) -> DataFrame:
    """Quads of a table with a column ``value`` of N-Triples or N-Quads lines; bad lines raise."""
    kept = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = [F.regexp_extract("value", _LINE, i) for i in range(1, 5)]
    bad = F.when(parts[0] == "", F.raise_error(F.concat(F.lit("not an RDF line: "), F.col("value"))).cast("string"))
    cells = kept.select(F.coalesce(bad, parts[0]).alias("s"), parts[1].alias("p"), parts[2].alias("o"), parts[3].alias("g"))
    g = F.when(F.col("g") != "", canonical(F.col("g"))).otherwise(F.lit(graph))
    return cells.select(canonical(F.col("s")).alias("s"), canonical(F.col("p")).alias("p"), canonical(F.col("o")).alias("o"), g.alias("g"))


def parse_turtle(text: str, graph: str = DEFAULT_GRAPH, label: str = "t") -> list[tuple[str, str, str, str]]:
    """Quads of a Turtle document; blank nodes get labels that start with ``label``."""
    from ..plans import algebra as A
    from ..plans.parser import Parser

    text = re.sub(r"(?m)@(prefix|base)\b", lambda m: m.group(1).upper(), text)
    text = re.sub(r"(?m)^(\s*(?:PREFIX\s+\S*:|BASE)\s*<[^>]*>)\s*\.", r"\1", text)
    p, out = Parser(text), []
    p.prologue()

    def node(x) -> str:
        return x.text if isinstance(x, A.Term) else T.blank(label + re.sub(r"\W", "", x.name))

    while p.kind != "end":
        p.subject_triples(lambda s, q, o: out.append((node(s), node(q), node(o), graph)), paths=False)
        p.take(".")
        p.prologue()
    return out


def read_rdf(spark: SparkSession, path: str, kind: str | None = None, graph: str | None = None) -> DataFrame:
    """(s, p, o, g), duplicates dropped. ``graph`` names the graph of formats without one."""
    kind, graph = kind or detect_format(path), graph or DEFAULT_GRAPH
    if kind in ("ntriples", "nquads"):
        out = parse_lines(spark.read.text(path), graph)
    elif kind == "jsonl":
        raw = spark.read.schema("s string, p string, o string, g string").json(path)
        out = raw.select(*(canonical(F.col(c)).alias(c) for c in "spo"), F.coalesce(canonical(F.col("g")), F.lit(graph)).alias("g"))
    elif kind == "parquet":
        out = spark.read.parquet(path).select("s", "p", "o", "g")
    else:
        files = spark.read.text(path, wholetext=True).withColumn("name", F.md5(F.input_file_name()))

        def run(parts):
            import pandas as pd

            for pdf in parts:
                rows = [q for text, name in zip(pdf["value"], pdf["name"], strict=True) for q in parse_turtle(text, graph, name[:8])]
                yield pd.DataFrame(rows, columns=["s", "p", "o", "g"])

        out = files.mapInPandas(run, QUAD_SCHEMA)
    return out.dropDuplicates(["s", "p", "o", "g"])


def nt_text(c: Column) -> Column:
    """Canonical term to N-Triples text."""
    first = F.left(c, F.lit(1))
    lex = F.when(first == "S", F.substr(c, F.lit(2))).otherwise(F.substr(c, F.instr(c, " ") + 1))
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(old), F.lit(new))
    tag = F.substr(c, F.lit(2), F.instr(c, " ") - 2)
    quoted = F.concat(F.lit('"'), lex, F.lit('"'))
    return (
        F.when(first == "I", F.concat(F.lit("<"), F.substr(c, F.lit(2)), F.lit(">")))
        .when(first == "B", F.concat(F.lit("_:"), F.substr(c, F.lit(2))))
        .when(first == "G", F.concat(quoted, F.lit("@"), tag))
        .when(first == "T", F.concat(quoted, F.lit("^^<"), tag, F.lit(">")))
        .otherwise(quoted)
    )


def to_lines(quads: DataFrame, named: bool = True) -> DataFrame:
    """N-Quads lines (N-Triples without ``named``); the default graph has no fourth term."""
    g = F.when(F.col("g") == DEFAULT_GRAPH, F.lit("")).otherwise(F.concat(F.lit(" "), nt_text(F.col("g")))) if named else F.lit("")
    return quads.select(F.concat(nt_text(F.col("s")), F.lit(" "), nt_text(F.col("p")), F.lit(" "), nt_text(F.col("o")), g, F.lit(" .")).alias("value"))


def write_rdf(quads: DataFrame, path: str, kind: str = "nquads", graph: str | None = None, limit: int | None = None, mode: str = "error") -> None:
    """Export; Turtle is written as its N-Triples subset. ``graph`` and ``limit`` restrict the rows."""
    if graph is not None:
        quads = quads.where(F.col("g") == graph)
    if limit is not None:
        quads = quads.limit(limit)
    if kind == "jsonl":
        quads.select(*(nt_text(F.col(c)).alias(c) for c in "spo"), F.when(F.col("g") != DEFAULT_GRAPH, nt_text(F.col("g"))).alias("g")).write.mode(mode).json(path)
    elif kind == "parquet":
        quads.write.mode(mode).partitionBy().parquet(path)
    else:
        to_lines(quads, kind == "nquads").write.mode(mode).text(path)


