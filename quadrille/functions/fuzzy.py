"""Fuzzy matching of names: shingles, MinHash bands, phonetic codes, typo variants and name scores."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType

from .measures import trigrams

#: Shingle length, permutations, and bands for a candidate threshold near 0.3.
K, PERMUTATIONS, BANDS = 3, 64, 32
#: Candidates by bands that are enough to go no further down in shared bands.
FEWEST = 20


def plain_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def shingles(text: Column, k: int = K) -> Column:
    t = plain_text(text)
    whole = F.array(t)
    return F.array_distinct(F.when(F.length(t) < k, whole).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - (k - 1)), lambda i: F.substr(t, i, F.lit(k)))))


def minhash(grams: Column, n: int = PERMUTATIONS) -> Column:
    def least(i: int) -> Column:
        return F.array_min(F.transform(grams, lambda g: F.xxhash64(F.lit(i), g)))

    return F.array(*map(least, range(n)))


def bands(signature: Column, n: int = PERMUTATIONS, count: int = BANDS) -> Column:
    """Hash of each band, as (band, hash) structs."""
    rows = n // count
    return F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), *(F.get(signature, F.lit(b * rows + r)) for r in range(rows))).alias("hash")) for b in range(count)))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), with one row of the table held as the bits of an integer."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    lcs = len(a) - row.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def pair_score(a: str | None, b: str | None) -> float | None:
    """The better of the token-sort and token-set ratios."""
    if a is None or b is None:
        return None
    x, y = sorted(_tokens(a)), sorted(_tokens(b))
    by_sort = indel_ratio(" ".join(x), " ".join(y))
    both, left, right = (sorted(s) for s in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    base, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    by_set = max(indel_ratio(one, two), indel_ratio(base, one) if both else 0.0, indel_ratio(base, two) if both else 0.0)
    return max(by_sort, by_set)


@F.pandas_udf(DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pair_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# The rules of the Metaphone code, applied in order to an upper-case word; what is decided is
# written in lower case, so that no later rule sees it.
METAPHONE = [
    (r"([ABD-Z])\1", "$1"),
    (r"^X", "s"),
    (r"^WH", "w"),
    (r"MB$", "m"),
    (r"TCH", "x"),
    (r"SCH", "sk"),
    (r"CIA", "xA"),
    (r"CH", "x"),
    (r"SC(?=[IEY])", "s"),
    (r"C(?=[IEY])", "s"),
    (r"CK|C|Q", "k"),
    (r"DG(?=[EIY])", "j"),
    (r"D", "t"),
    (r"GH(?![AEIOU])", ""),
    (r"GN(?=$|ED$)", "n"),
    (r"G(?=[IEY])", "j"),
    (r"G", "k"),
    (r"PH", "f"),
    (r"SH|S(?=I[OA])", "x"),
    (r"T(?=I[OA])", "x"),
    (r"TH", "0"),
    (r"(?<=[AEIOU])H(?![AEIOU])", ""),
    (r"(?<=[ksptxj])H", ""),
    (r"V", "f"),
    (r"X", "ks"),
    (r"Z", "s"),
    (r"[WY](?![AEIOU])", ""),
    (r"(?<!^)[AEIOU]", ""),
]


def metaphone(word: Column) -> Column:
    """Metaphone code of a word of letters."""
    c = F.upper(word)
    # of some pairs at the start the first letter is silent
    c = F.when(F.rlike(c, F.lit("^(?:AE|GN|KN|PN|WR)")), F.substr(c, F.lit(2))).otherwise(c)
    for pattern, by in METAPHONE:
        c = F.regexp_replace(c, pattern, by)
    return F.upper(c)


def words_in(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"[^A-Za-z]+", " ")), " "), lambda w: w != "")


def phonetic(text: Column) -> Column:
    """Soundex and Metaphone codes of each word."""
    words = words_in(text)
    sounds = F.transform(words, lambda w: F.concat(F.lit("S"), F.soundex(w)))
    return F.array_distinct(F.concat(sounds, F.transform(words, lambda w: F.concat(F.lit("M"), metaphone(w)))))


def level(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "likely").when(score.isNotNull(), "possible")


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two words differ by one deletion, insertion, replacement or transposition of neighbours."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (a != b) & (F.abs(F.length(a) - F.length(b)) <= 1) & ((F.levenshtein(a, b) <= 1) | (F.length(a) == F.length(b)) & swapped)


def signed(names: DataFrame, name: str) -> DataFrame:
    """The table with its signatures, in steps, so that each is computed once for all bands."""
    return names.withColumn("_grams", shingles(F.col(name))).withColumn("_signature", minhash(F.col("_grams"))).drop("_grams")


def band_index(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(band, hash, id): the LSH index of a table of names."""
    rows = signed(names, name).select(F.col(key).alias("id"), F.explode(bands(F.col("_signature"))).alias("b"))
    return rows.select("b.band", "b.hash", "id")


_WORD_64 = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def xxhash64_from(starts: np.ndarray, data: bytes) -> np.ndarray:
    """Spark's xxhash64 of fewer than 32 bytes, as signed numbers, after each of the hashes ``starts``."""
    u = np.uint64
    turn = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    h = starts + u((_P5 + len(data)) & _WORD_64)
    at = 0
    while at + 8 <= len(data):
        k = int.from_bytes(data[at : at + 8], "little") * _P2 & _WORD_64
        k = ((k << 31 | k >> 33) & _WORD_64) * _P1 & _WORD_64
        h, at = turn(h ^ u(k), 27) * u(_P1) + u(_P4), at + 8
    if at + 4 <= len(data):
        h, at = turn(h ^ u(int.from_bytes(data[at : at + 4], "little") * _P1 & _WORD_64), 23) * u(_P2) + u(_P3), at + 4
    for b in data[at:]:
        h = turn(h ^ u(b * _P5 & _WORD_64), 11) * u(_P1)
    h = (h ^ (h >> u(33))) * u(_P2)
    h = (h ^ (h >> u(29))) * u(_P3)
    return (h ^ (h >> u(32))).view(np.int64)


#: Hashes of shingles, and codes of words, that a worker keeps.
KEPT = 50_000
_kept: dict[str, np.ndarray] = {}


def shared_bands(signature: list[int], starts: list[int], k: int = K):
    """A function of normalised names that counts the bands of their signatures equal to one of ``signature``:
    the same numbers as ``minhash`` and ``bands`` give, with the hashes of a shingle worked out once."""
    want, first = np.array(signature, dtype=np.int64), np.array(starts, dtype=np.int64).view(np.uint64)

    @F.pandas_udf(IntegerType())
    def hits(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows = []
            for gram in {t[i : i + k] for i in range(len(t) - k + 1)} or {t}:
                row = _kept.get(gram)
                if row is None:
                    if len(_kept) >= KEPT:
                        _kept.clear()
                    row = _kept[gram] = xxhash64_from(first, gram.encode("utf-8"))
                rows.append(row)
            same = np.minimum.reduce(rows) == want
            out.append(int(same.reshape(BANDS, -1).all(axis=1).sum()))
        return pd.Series(out, dtype="int32")

    return hits


def soundex(word: str) -> str:
    """Spark's soundex of a word of letters."""
    codes = "01230127022455012623017202"
    place = [codes[ord(c) - 65] for c in word.upper()]
    out, last = word[0].upper(), place[0]
    for c in place[1:]:
        if c != "7":
            out += c if c not in ("0", last) else ""
            last = c
    return out[:4].ljust(4, "0")


@lru_cache(maxsize=KEPT)
def sounds_of(word: str) -> frozenset[str]:
    """The codes that ``phonetic`` gives a word."""
    c = word.upper()
    c = c[1:] if re.match("AE|GN|KN|PN|WR", c) else c
    for pattern, by in METAPHONE:
        c = re.sub(pattern, by.replace("$1", r"\1"), c)
    return frozenset(("S" + soundex(word), "M" + c.upper()))


def sounding_like(codes: list[str]):
    """A function of names: whether a word has one of the codes."""
    asked = frozenset(codes)

    @F.pandas_udf(BooleanType())
    def sounds(names: pd.Series) -> pd.Series:
        return pd.Series([any(not asked.isdisjoint(sounds_of(w)) for w in re.findall("[A-Za-z]+", n)) for n in names], dtype=bool)

    return sounds


def candidates(names: DataFrame, query: str, name: str = "name", fewest: int = FEWEST, most: int | None = None) -> DataFrame:
    """The rows that may be like the query, with ``_hits`` shared bands and whether a code ``_sounds`` alike.

    Rows that share a phonetic code, or have a word one edit away from a word of the query, count as they
    are. By bands the strictest number of hits is taken that gives ``fewest`` rows, and of many rows with
    ``most`` the best. Where nothing is found by these, rows with a trigram in common are taken.
    """
    from ..operators.cut import cut

    asked = names.sparkSession.createDataFrame([(query,)], "name string")
    starts = F.array(*(F.xxhash64(F.lit(i)) for i in range(PERMUTATIONS)))
    one = signed(asked, "name").select(F.col("_signature").alias("b"), phonetic(F.col("name")).alias("p"), trigrams(F.col("name")).alias("t"), starts.alias("starts")).first()  # the query's one row
    words = [w for w in _tokens(query) if w]
    hits = shared_bands(one.b, one.starts)(plain_text(F.col(name)))
    sounds = sounding_like(one.p)(F.col(name)) if one.p else F.lit(False)
    own = F.regexp_extract_all(F.lower(name), F.lit(r"\w+"), F.lit(0))
    typo = F.exists(own, lambda w: reduce(lambda x, y: x | y, (one_edit_apart(F.lit(q), w) for q in words))) if words else F.lit(False)
    # a table of names is small on disk, so its few splits are dealt out to all cores
    dealt = names.where(F.col(name).isNotNull()).repartition(2 * names.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.withColumn("_hits", hits).withColumn("_sounds", sounds).withColumn("_typo", F.coalesce(typo, F.lit(False)))
    rows = cut(rows)  # read for the counts and for the candidates
    found = {r["_hits"]: r.n for r in rows.where("_hits > 0").groupBy("_hits").agg(F.count("*").alias("n")).collect()}  # a row a band at most
    strict, total = 1, 0
    for strict in sorted(found, reverse=True):
        total += found[strict]
        if total >= fewest:
            break
    by_band = rows.where(F.col("_hits") >= strict)
    if most is not None and total > most:
        by_band = by_band.orderBy(F.desc("_hits")).limit(most)
    rest = rows.where(F.col("_hits") < strict)
    chosen = by_band.unionByName(rest.where("_sounds or _typo"))
    if not found and chosen.isEmpty() and one.t:
        chosen = rows.where(F.arrays_overlap(trigrams(F.col(name)), F.array(*map(F.lit, one.t))))
    return chosen.drop("_typo")


def find_similar(names: DataFrame, query: str, least: float = 70.0, key: str = "id", name: str = "name") -> DataFrame:
    """(id, name, score, level) of the names like the query: candidates by bands, phonetic codes or a typo in
    a word, then scored, with 10 points (100 at most) for an equal phonetic code."""
    rows = candidates(names, query, name)
    score = F.least(F.lit(100.0), name_score(F.col(name), F.lit(query)) + F.when(F.col("_sounds"), 10.0).otherwise(0.0))
    return rows.select(F.col(key).alias("id"), F.col(name).alias("name"), score.alias("score")).where(F.col("score") >= least).withColumn("level", level(F.col("score")))


def duplicates(names: DataFrame, least: float = 90.0, key: str = "id", name: str = "name") -> DataFrame:
    """(a, b, score) of similar names: equal names collapse first.

    A score depends on the words alone, so names of equal words form a class, whose pairs score 100. Names
    whose words are, but for what ``least`` allows, among those of another one meet in their rare words.
    Other pairs of ``least`` need characters to spare, which short names do not have at a high ``least``;
    only names that have them are compared by bands. Pairs are what is asked for, so a table of many names
    that are all alike gives as many pairs.
    """
    from ..operators.cut import cut

    one = names.where(F.col(name).isNotNull()).groupBy(F.lower(F.trim(F.col(name))).alias("name")).agg(F.min(key).alias("id"))
    one = cut(one.withColumn("words", sorted_words("name")).withColumn("text", F.array_join("words", " ")))
    x, y = one.select("text", F.col("id").alias("a")), one.select("text", F.col("id").alias("b"))
    same = x.join(y, "text").where("a < b").select("a", "b", F.lit(100.0).alias("score"))
    near = sharing_words(one.groupBy("text").agg(F.first("words").alias("words")), least)
    near = near.withColumn("score", name_score("one", "two")).where(F.col("score") >= least)
    near = near.join(x.withColumnsRenamed({"text": "one"}), "one").join(y.withColumnsRenamed({"text": "two"}), "two")
    found = same.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"))
    loose = one.where(spare(F.length("text"), least) >= 1)
    if not loose.isEmpty():
        index = band_index(one)
        some = index.join(loose.select("id"), "id", "left_semi")
        pairs = index.alias("x").join(some.alias("y"), ["band", "hash"]).where("x.id <> y.id")
        pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(found, ["a", "b"], "left_anti")
        found = found.unionByName(_scored(pairs, one))
    return found.where(F.col("score") >= least)


@F.pandas_udf(ArrayType(StringType()))
def sorted_words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted(_tokens(t)))


def spare(length: Column, least: float) -> Column:
    """The most characters of a text of this length that another one may lack, for a ratio of ``least``."""
    # lacking is largest where the other text has nothing more: then 2 * kept / (length + kept) is the ratio
    r = min(max(least / 100.0, 0.0), 1.0)
    return F.floor(length * ((2 - 2 * r) / (2 - r)) + 1e-9)


#: Words in more texts than this count as frequent.
FREQUENT = 100


def sharing_words(classes: DataFrame, least: float) -> DataFrame:
    """(one, two) texts of which one has its words, but for those it may lack, in common with the other.

    Of the words that it may not all lack one at least is in common, whichever are taken; the rarest are.
    """
    posted = classes.select("text", F.explode(F.array_distinct("words")).alias("word"))
    frequent = posted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT)
    rated = posted.join(frequent, "word", "left").groupBy("text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("w"))
    size = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w["word"]) + 1)
    rated = rated.withColumn("most", spare(size(F.col("w")) - 1, least))
    asked = rated.select(F.col("text").alias("one"), F.explode(F.filter("w", lambda w, i: size(F.slice("w", F.lit(1), i)) <= F.col("most"))).alias("w"))
    met = asked.select("one", F.col("w.word").alias("word")).join(posted.withColumnRenamed("text", "two"), "word").where("one <> two")
    return met.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()


def _scored(pairs: DataFrame, names: DataFrame) -> DataFrame:
    out = pairs.join(names.select(F.col("id").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
    return out.select("a", "b", name_score("na", "nb").alias("score"))


def scored(names: DataFrame, query: str, least: float = 0.0) -> DataFrame:
    """(s, fuzzy) of a name index (s, name): scores of the candidates that reach ``least``."""
    rows = candidates(names, query, "name").select("s", name_score(F.col("name"), F.lit(query)).alias("fuzzy"))
    return rows.where(F.col("fuzzy") >= least)
