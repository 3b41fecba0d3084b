"""License scan by an exact set-similarity join, in DataFrame operations only.

Text blocks are word windows of the whole text, so a notice may be wrapped over any number of lines. A
window has a template's words divided by the containment. A template matches a window that holds at least
CONTAINMENT of its distinct tokens, the telling words among them, if it has any. Tokens are ordered by
global frequency, rarest first (counted over all documents; only tokens of some template can matter, so
only those are counted). With ``need`` tokens of a template's ``size`` required, a match must lie in a
document with ``need`` template tokens (length filter), hold one of the first size - need + 1 in that order
(prefix filter), and have enough tokens within reach on either side of it (positional filter). Around each
prefix token that is left all windows it lies in are counted in full, so no match is lost. A window may
begin at a template token, as any other can be moved to the next one without losing a token.

Templates are a list or a table (text, label). They are taken in batches of at most BATCH_TOKENS tokens,
so that what a plan holds and broadcasts is bounded however many there are; each batch is a pass over the
documents. Beside the templates, the places of fixed phrases are found over the whole text.

Defined results: a null text counts as empty; a document without words has 0 words, no places, empty
labels and score 0; repeated rows give one result each; templates that tie all give their labels; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ascii_lower, discard, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases with their labels, and the notices that blocks are held against.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]
CONTAINMENT = 0.8
#: Tokens of the templates that are looked for in one pass.
BATCH_TOKENS = 4096
#: Words without which a short notice names another licence.
TELLING = {"mit", "apache", "gnu", "nc", "mozilla"}


def tokens_of(template: str) -> list[str]:
    return list(dict.fromkeys(template.split()))


def need(size: int, containment: float) -> int:
    """Fewest of ``size`` tokens that reach the containment."""
    return math.ceil(containment * size - 1e-9)


def width(template: str, containment: float) -> int:
    """Words of a window that is held against a template."""
    return math.ceil(len(template.split()) / containment - 1e-9)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def places(found: Column, phrase: str) -> Column:
    """Starts (from 0) at which the phrase's words stand one after another."""
    parts = phrase.split()
    rarest = parts[0]

    def at(i: Column) -> Column:
        here = F.get(found, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            here = here & (F.get(found, i + k) == p)
        return here

    starts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), at)
    none = F.array().cast("array<int>")
    return F.when(F.array_contains(found, parts[-1]) & F.array_contains(found, rarest), starts).otherwise(none)


def literal_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def batches(templates: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """The templates in runs of at most BATCH_TOKENS tokens, one template at least."""
    run, held = [], 0
    for text, label in templates:
        size = len(tokens_of(text))
        if run and held + size > BATCH_TOKENS:
            yield run
            run, held = [], 0
        run.append((text, label))
        held += size
    if run:
        yield run


def hits_of(found: Column, seen: Column, vocabulary: list[str], least: int) -> Column:
    """(place, token) of the words in the vocabulary, of documents that can pass the length filter."""
    placed = F.transform(found, lambda w, i: F.struct(i.alias("at"), w.alias("t")))
    return F.when(F.size(seen) >= least, F.filter(placed, lambda x: x["t"].isin(vocabulary)))


def in_windows(found: DataFrame, prefix: DataFrame, whole: DataFrame, widths: dict[int, int]) -> DataFrame:
    """(id, h, label, size, both) of the windows around prefix words that reach ``need``."""
    most = max(widths.values())
    at = found.select("id", "h", "hits", F.posexplode("hits").alias("k", "hit"))
    at = at.select("id", "h", "hits", "k", F.col("hit.at").alias("at"), F.col("hit.t").alias("token"))
    met = at.join(F.broadcast(prefix.select("token", "template", "size", "need")), "token").join(F.broadcast(whole), "template")
    # places rise, so what lies within ``most`` words lies within ``most`` hits
    around = F.slice("hits", F.greatest(F.col("k") - most, F.lit(0)) + 1, 2 * most + 1)
    own = F.filter(around, lambda x: (x["at"] > F.col("at") - F.col("w")) & (x["at"] < F.col("at") + F.col("w")) & F.array_contains("tokens", x["t"]))
    met = met.withColumn("near", own).where(F.size(F.array_distinct(F.transform("near", lambda x: x["t"]))) >= F.col("need"))
    starts = F.filter("near", lambda x: x["at"] <= F.col("at"))

    def held(x: Column) -> Column:
        inside = F.filter("near", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("w")))
        return F.array_distinct(F.transform(inside, lambda y: y["t"]))

    telling = F.array_intersect("tokens", literal_array(sorted(TELLING)))
    counts = F.transform(starts, lambda x: F.when(F.size(F.array_except(telling, held(x))) == 0, F.size(held(x))).otherwise(0))
    return met.withColumn("both", F.array_max(counts)).where("both >= need").select("id", "h", "label", "size", "both")


def matched(found: DataFrame, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(id, h, label, size, both) of a batch of templates; ``found`` has id, h, seen and hits."""
    frequency = {t: 0 for text, _ in templates for t in tokens_of(text)}
    for row in found.select(F.explode("seen").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect():  # a row for each token of the batch
        frequency[row.token] = row.n
    order = sorted(frequency, key=lambda t: (frequency[t], t))
    rank = {t: i for i, t in enumerate(order)}
    session = found.sparkSession
    ordered = [(k, sorted(tokens_of(text), key=rank.__getitem__), label, width(text, containment)) for k, (text, label) in enumerate(templates)]
    prefixes = [(t, k, len(tokens), need(len(tokens), containment)) for k, tokens, _, _ in ordered for t in tokens[: len(tokens) - need(len(tokens), containment) + 1]]
    prefix = session.createDataFrame(prefixes, "token string, template int, size int, need int")  # at most BATCH_TOKENS rows, or one template's
    whole = session.createDataFrame(ordered, "template int, tokens array<string>, label string, w int")
    return in_windows(found, prefix, whole, {k: w for k, _, _, w in ordered})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, templates: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score; one row an input row."""
    if isinstance(templates, DataFrame):
        # license texts and no corpus: what is too large for the driver's results is an error there
        templates = [(" ".join(re.findall(WORD, (r[0] or "").translate(ASCII_LOWER))), r[1]) for r in templates.select("text", "label").distinct().orderBy("text", "label").collect()]
    templates = [t for t in (TEMPLATES if templates is None else templates) if t[0].strip()]
    low = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.select(docs[id_col].alias("id"), low.alias("low")).withColumn("words", words(F.col("low")))
    basic = [
        F.size("words").cast("long").alias("n_words"),
        *(places(F.col("words"), phrase).alias(f"at{i}") for i, (phrase, _) in enumerate(PHRASES)),
    ]

    found, temporary, parts = None, [], []
    for batch in batches(templates):
        vocabulary = sorted({t for text, _ in batch for t in tokens_of(text)})
        least = min(need(len(tokens_of(text)), containment) for text, _ in batch)
        seen = F.array_intersect("words", literal_array(vocabulary)).alias("seen")
        one = rows.select("id", F.xxhash64("low").alias("h"), *(basic if found is None else []), seen, "words")
        one = stored(one.withColumn("hits", hits_of(F.col("words"), F.col("seen"), vocabulary, least)).drop("words"), "scan")
        temporary.append(one)
        found = one if found is None else found
        parts.append(matched(one, batch, containment))
    if found is None:
        found = stored(rows.select("id", F.xxhash64("low").alias("h"), *basic), "scan")
        temporary.append(found)
        parts.append(found.limit(0).select("id", "h", F.lit("").alias("label"), F.lit(1).alias("size"), F.lit(0).alias("both")))
    # rows of equal id and text have equal matches
    matches = reduce(DataFrame.unionByName, parts).groupBy("id", "h").agg(F.collect_set("label").alias("more"), F.max(F.col("both") / F.col("size")).alias("part"))
    matches = matches.select(F.col("id").alias("mid"), F.col("h").alias("mh"), "more", "part")  # at most a label for each template

    every = F.array_sort(F.concat(*(F.col(f"at{i}") for i in range(len(PHRASES)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))))
    done = found.withColumn("every", every).withColumn("base", base).join(matches, F.col("id").eqNullSafe(F.col("mid")) & (F.col("h") == F.col("mh")), "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    done = done.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.get("every", F.lit(0)).cast("long").alias("first_word"),
        F.get("every", F.size("every") - 1).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )
    done = stored(done, "licenses")
    for old in temporary:
        discard(old)
    return done
