"""Native column expressions for vectors, texts and places."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_008.8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def constant_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def cosine(a: Column, b: Column | list[float]) -> Column:
    """Cosine similarity in double precision; null for zero vectors and unequal lengths.

    Against a constant vector the product and the vector's own square are summed in one pass, and the
    norm of the constant is computed here.
    """
    if not isinstance(b, list):
        size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)
    norm = math.sqrt(math.fsum(v * v for v in b))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"))
    pairs = F.zip_with(a, constant_vector(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y")))
    sums = F.aggregate(pairs, start, lambda s, p: F.struct((s["d"] + p["x"] * p["y"]).alias("d"), (s["q"] + p["x"] * p["x"]).alias("q")), lambda s: F.when(s["q"] * F.lit(norm) > 0, s["d"] / (F.sqrt(s["q"]) * F.lit(norm))))
    return F.when(F.size(a) == len(b), sums)


def hashing_embedder(dimensions: int = 64):
    """A deterministic embedder: words hashed to signed dimensions."""

    def embed(text: str) -> list[float]:
        out = [0.0] * dimensions
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.md5(w.encode("utf-8")).digest()[:8], "big")
            out[h % dimensions] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def haversine(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(to_lat - lat), F.radians(to_lon - lon)
    h = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * F.sin(dlon / 2) ** 2
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_radius(lat: Column, lon: Column, at_lat: float, at_lon: float, metres: float) -> Column:
    """Distance test behind a latitude band, which a scan can use."""
    band = math.degrees(metres / EARTH_METRES)
    return lat.between(at_lat - band, at_lat + band) & (haversine(lat, lon, F.lit(at_lat), F.lit(at_lon)) <= metres)


def within_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a ring of (lon, lat) corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            cut = (F.lit(x2 - x1) * (lat - y1) / (y2 - y1)) + x1
            crossings = crossings + (((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < cut)).cast("int")
    return crossings % 2 == 1


def polygon(wkt: str) -> list[tuple[float, float]]:
    inner = re.search(r"\(\(([^)]*)\)", wkt).group(1)
    ring = [tuple(map(float, p.split())) for p in inner.split(",")]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def text_score(words: Column, query: str) -> Column:
    """Share of a text's words that are query words; null unless all of them occur."""
    wanted = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    if not wanted:
        return F.lit(None).cast("double")
    every = F.size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) == len(wanted)
    hits = F.size(F.filter(words, lambda w: w.isin(*wanted)))
    return F.when(every, hits.cast("double") / F.size(words))


def trigrams(text: Column) -> Column:
    """Distinct 3-letter grams of each word, the word padded by two blanks before and one behind."""
    padded = F.transform(words_of(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both))
