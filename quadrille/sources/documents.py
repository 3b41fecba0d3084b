"""Documents: HTML to Markdown and segmentation by headings or paragraphs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TOKENS, FEWEST_TOKENS, OVERLAP = 512, 50, 0
_SKIPPED = {"script", "style", "head", "noscript", "template"}


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.href: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol", "blockquote", "footer", "nav"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a":
            self.href = dict(attrs).get("href")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a":
            self.out.append(f"]({self.href})" if self.href else "]")
        elif re.fullmatch("h[1-6]|p", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))).strip()


def pieces(text: str, most: int, overlap: int = 0) -> list[str]:
    """Split at paragraphs, then sentences, then words, so that no piece has more than ``most`` words."""
    units = [u for para in re.split(r"\n\s*\n", text) for u in ([para] if len(para.split()) <= most else re.split(r"(?<=[.!?])\s+", para))]
    flat: list[list[str]] = []
    for u in units:
        words = u.split()
        flat += [words[i : i + most] for i in range(0, len(words), most)]
    out: list[list[str]] = []
    for words in flat:
        if out and len(out[-1]) + len(words) <= most:
            out[-1] = out[-1] + words
        else:
            out.append((out[-1][-overlap:] if out and overlap else []) + words if len(words) + overlap <= most else words)
    return [" ".join(w) for w in out]


def segments(text: str | None, method: str = "auto", most: int = MOST_TOKENS, fewest: int = FEWEST_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, str, str, int]]:
    """(number, heading, text, tokens): by Markdown headings where there are any, else plain; a short
    segment joins the one before it."""
    text = (text or "").strip()
    if not text:
        return []
    parts: list[tuple[str, str]] = []
    if method == "markdown" or (method == "auto" and re.search(r"(?m)^#{1,6} \S", text)):
        heading, body = "", []
        for line in text.split("\n"):
            if m := re.match(r"#{1,6} (.*)", line):
                parts.append((heading, "\n".join(body)))
                heading, body = m.group(1).strip(), []
            else:
                body.append(line)
        parts.append((heading, "\n".join(body)))
    else:
        parts = [("", text)]
    found: list[tuple[str, str]] = []
    for heading, body in parts:
        for piece in pieces(body, most, overlap) if body.strip() else []:
            if found and len(piece.split()) < fewest and len(found[-1][1].split()) + len(piece.split()) <= most:
                found[-1] = (found[-1][0], found[-1][1] + " " + piece)
            else:
                found.append((heading, piece))
    return [(i, h, p, len(p.split())) for i, (h, p) in enumerate(found)]


def segmented(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id_col, segment, heading, text, tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts):
        for pdf in parts:
            rows = [(i, *s) for i, t in zip(pdf["id"], pdf["text"], strict=True) for s in segments(t, **options)]
            yield pd.DataFrame(rows, columns=["id", "segment", "heading", "text", "tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, segment int, heading string, text string, tokens int")
    return out.withColumnRenamed("id", id_col)


def markdown(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "markdown": [to_markdown(h) for h in pdf["html"]]})

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, markdown string").withColumnRenamed("id", id_col)
