"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of minhash bands are computed for a document, ``halves`` bands of ``rows``
values each. A table's key combines band i of the first with band j of the second, for ``span`` of the
j (from i on, in a circle), so halves * span tables come from only 2 * halves * rows minhashes. A pair
meets unless no two agreeing bands are combined. The bands follow from the threshold (``bands_for``),
so that a pair just at it is missed with probability MISSED at most:

* threshold 0.85 and more, 12 x 5 with span 12: missed with 1.8e-3 at s = 0.85 and 4e-5 at 0.9; at
  s = 0.4 a pair meets with probability 0.014;
* threshold 0.8, 18 x 4 with span 4: missed with 9.5e-4 at s = 0.8, 2.4e-4 at 0.82 and 1.8e-5 at 0.85;
  at s = 0.4 a pair meets with probability 0.043. 72 tables in place of 144.

1. Equal shingle sets are one class, which stands for all its documents.
2. Keys are formed only from bands that some other set has too: who shares a table's key shares both of
   its bands, so nothing is lost, and of a corpus with few copies few keys are left.
3. Every set proposes two links: of the smallest sets of its buckets, to the smallest of all and to the one
   it shares most tables with. Proposals are verified on full sets and contracted to components. A bucket
   whose entries then belong to one component is done, however large it is.
4. In the buckets that are left, entries outside the bucket's largest component propose links to members of
   it drawn by hash, DRAWN of them, which joins most of what a chance leader missed.
5. In the buckets that are still left, entries outside the largest component meet all entries of other
   components. Buckets of up to SMALL entries list those pairs; larger ones compare in blocks, whose
   pairs never become rows. Either way decides every pair, so the switch changes the plan and not the
   result. Pairs that differ too much in size or agree in too few minhashes are dropped (the bound lies
   5.2 standard deviations below the threshold, so a pair at it is lost with probability 1e-7); the
   others are verified on full sets and the links contracted again.

So links within large groups are found without pairing the group, and no bucket is capped. Sets are
computed twice, the second time only for the documents that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_LEAST, HOT_VALUES, TEXT_ROWS, discard, keys_of, spaced_words, spread_join, stored
from .components import components

#: Largest probability with which a pair just at the threshold may be missed.
MISSED = 2e-3


class Bands(NamedTuple):
    halves: int
    rows: int
    span: int

    @property
    def hashes(self) -> int:
        return 2 * self.halves * self.rows

    def missed(self, s: float) -> float:
        """Probability that a pair of similarity ``s`` meets in no table, over all sets of agreeing first bands."""
        first = np.arange(2**self.halves, dtype=np.int64)
        met = np.zeros_like(first)  # second bands that are combined with one of them
        for d in range(self.span):
            met |= ((first << d) | (first >> (self.halves - d))) & (2**self.halves - 1)
        q, n = s**self.rows, np.bitwise_count(first).astype(float)
        return float((q**n * (1 - q) ** (self.halves - n + np.bitwise_count(met))).sum())

    def least_agreement(self, percent: int) -> int:
        """Smallest number of equal minhashes a candidate must have: 5.2 deviations below the mean."""
        s = percent / 100
        return int(self.hashes * s - 5.2 * (self.hashes * s * (1 - s)) ** 0.5)

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Factors and summands of the linear maps whose minima are taken."""
        rng = np.random.default_rng(20240607)
        mul = (rng.integers(0, 2**31, self.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        return mul, rng.integers(0, 2**32, self.hashes, dtype=np.uint32)[:, None]


#: From few accidental meetings to many.
CHOICES = [Bands(12, 5, 12), *(Bands(18, rows, span) for rows in (4, 3, 2, 1) for span in (4, 9, 18))]


@lru_cache
def bands_for(percent: int) -> Bands:
    """The first choice that misses few pairs at the threshold; below 0.33 the last one, which misses more."""
    return next((b for b in CHOICES if b.missed(percent / 100) <= MISSED), CHOICES[-1])


#: Members of larger components that an entry is compared with before all of them are.
DRAWN = 4
#: Entries up to which a bucket's open pairs are listed; entries and shingles in a block of larger ones.
SMALL, BLOCK, BLOCK_SHINGLES = 8, 4096, 4 << 20

_W = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_MEMO = 500_000
_BLOCK = 2048


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words_in: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    Fewer words than a shingle has make one shingle of the whole sequence, no words an empty set.
    """
    if len(memo) > _MEMO:
        memo.clear()
    words = spaced_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(words_in, len(h))
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = mix(total * _W[3] + h[i : i + len(total)] * _W[i % 3] + _W[4])
    return np.unique(total)


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def minhashes(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """A minimum for each linear map, in blocks so that long texts need little memory."""
    best = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)  # well mixed, so a linear map a function will do
    for at in range(0, len(low), _BLOCK):
        np.minimum(best, (low[None, at : at + _BLOCK] * mul + add).min(axis=1), out=best)
    return mix(best.astype(np.uint64) + np.arange(len(mul), dtype=np.uint64) * _W[1])


#: A class of equal sets is named by 64 bits of its digest, as shingles are by 64 bits of theirs.
SKETCH = "doc long, n long, id long, bands array<long>, sketch binary"


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: Bands) -> DataFrame:
    """For each row its set size, a hash of its set, 2 * halves band hashes and one byte of each minhash."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, maps = WordHashes(), bands.functions()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                rows = batch.slice(at, TEXT_ROWS).to_pydict()
                out: dict = {"doc": rows["doc"], "n": [], "id": [], "bands": [], "sketch": []}
                for text in rows["text"]:
                    s = shingle_set(text, words, memo)
                    out["n"].append(len(s))
                    out["id"].append(set_id(s))
                    if len(s):
                        low = minhashes(s, *maps)
                        band = np.zeros(2 * bands.halves, dtype=np.uint64)
                        for r in range(bands.rows):
                            band = mix(band * _W[0] + low[r :: bands.rows] + _W[4])
                        out["bands"].append(band.view(np.int64))
                        out["sketch"].append((low & np.uint64(255)).astype(np.uint8).tobytes())
                    else:
                        out["bands"].append(None)
                        out["sketch"].append(None)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(id, shingles binary): for each row the hash of its set and the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sets = [shingle_set(t, words, memo) for t in batch.slice(at, 64).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["id", "shingles"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "id long, shingles binary")


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int, bands: Bands) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    least, hashes = bands.least_agreement(percent), bands.hashes
    side = reps.select("id", "n", "sketch")
    a, b = (side.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, hashes) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def block_links(entries: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, bands: Bands) -> DataFrame:
    """Verified links (a, b) between components of large buckets.

    Large buckets that share entries are one cluster, so a pair is compared once and not once a table.
    A cluster is dealt to blocks of bounded count and bytes, and a group holds two of them. A first pass
    compares sizes and sketches alone and names the members that have a possible partner there; only
    these bring their full sets to the second, which gives for each entry one link to each other component.
    """
    least, hashes = bands.least_agreement(percent), bands.hashes
    hub = entries.groupBy("key").agg(F.min("id").alias("hub"))
    cluster = components(entries.join(hub, "key").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    own = entries.select("id", "c").distinct().join(cluster.withColumnRenamed("component", "cluster"), "id")
    own = stored(own.join(reps.select("id", F.col("n").alias("size"), "sketch"), "id"), "clusters")
    enough = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    rows = own.join(own.groupBy("cluster").agg(enough), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", "c", "size", "sketch")

    def partners(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Each member's place with the places of smaller ids of other components that may be near."""
        ids, c, size, block = (part[x].to_numpy() for x in ("id", "c", "size", "block"))
        sketch = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(-1, hashes)
        one_block = part["b1"].iloc[0] == part["b2"].iloc[0]
        for i in range(len(ids)):
            other = (c != c[i]) & (ids < ids[i])
            if not one_block:
                other &= block != block[i]
            near = np.flatnonzero(other & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent))
            near = near[(sketch[near] == sketch[i]).sum(axis=1) >= least]
            if len(near):
                yield i, near

    def needed(part: pd.DataFrame) -> pd.DataFrame:
        mark = np.zeros(len(part), dtype=bool)
        for i, near in partners(part):
            mark[i] = mark[near] = True
        return part[mark]

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        ids, c, size = (part[x].to_numpy() for x in ("id", "c", "size"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
        found: list[tuple[int, int]] = []
        for i, near in partners(part):
            reached = set()
            for k in near.tolist():
                if c[k] not in reached:
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[k] - both):
                        reached.add(c[k])
                        found.append((ids[i], ids[k]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    asked = stored(rows.groupBy("cluster", "b1", "b2").applyInPandas(needed, rows.schema), "blocks")
    links = stored(asked.join(sets, "id").groupBy("cluster", "b1", "b2").applyInPandas(compare, "a long, b long"), "links")
    for old in (cluster, own, asked):
        discard(old)
    return links


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union|, counted on full sets."""
    a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    met = a.join(keys_of(pairs, "a"), "a").join(b, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def shared_bands(reps: DataFrame, bands: Bands) -> DataFrame:
    """(id, first, second): of each set the (place, hash) of those bands of either half that another set has too.

    Sets that meet in a table share both of its bands, so dropping the others, before any are combined,
    loses nothing and leaves few keys. Bands are stored one a row: only then can Spark thin them by a
    Bloom filter before they are shuffled, as it does not look through the generator that lists them.
    """
    half = reps.select("id", F.posexplode("bands").alias("p", "x")).select("id", "p", F.xxhash64("p", "x").alias("band"))
    half = stored(half, "halves")
    counts = stored(half.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    often = 2 * bands.halves * reps.count() // HOT_VALUES + HOT_LEAST
    hot = counts.where(F.col("n") > often).select("band", F.lit(True).alias("hot"))  # HOT_VALUES rows at most
    marked = half.join(F.broadcast(hot), "band", "left")
    rare = marked.where("hot is null").join(keys_of(counts.where(F.col("n") <= often), "band").select("band"), "band", "left_semi")
    met = stored(rare.unionByName(marked.where("hot")).select("id", "p", "band"), "bands", prune=True)
    discard(half)
    discard(counts)
    listed = met.groupBy("id").agg(F.collect_list(F.struct("p", "band")).alias("met"))  # at most 2 * halves
    sides = (F.filter("met", lambda b: b["p"] < bands.halves), F.filter("met", lambda b: b["p"] >= bands.halves))
    kept = stored(listed.select("id", sides[0].alias("first"), sides[1].alias("second")).where("size(first) > 0 and size(second) > 0"), "met")
    discard(met)
    return kept


def table_entries(reps: DataFrame, bands: Bands) -> DataFrame:
    """(key, i, id, low): the entries of all buckets that hold several sets, and the smallest of the bucket."""
    met = shared_bands(reps, bands)
    one = met.select("id", F.explode("first").alias("f"), "second").select("id", "f", F.explode("second").alias("s"))
    combined = F.pmod(F.col("s.p") - F.col("f.p"), F.lit(bands.halves)) < bands.span
    keys = one.where(combined).select("id", F.col("f.p").alias("i"), F.xxhash64("f.band", "s.band").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    entries = stored(keys.join(shared.select("key", "low"), "key"), "buckets")
    discard(met)
    return entries


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Links join rows whose sets have 100 * |A & B| >= percent * |A | B|; component_id is the smallest
    id reachable by links, kept marks the rows with that id. Every row is a document of its own, so
    rows that repeat an id with another text have their own links, and repeated rows one result each.
    Null and wordless texts have empty sets and link with nothing. A row with a null id links with
    nothing, its component is null and it is kept. An empty table gives no rows.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    bands = bands_for(percent)
    rows = stored(sketches(docs, "doc", "text", words, bands), "sketches")
    linked = rows.where("n > 0 and doc is not null")
    # a class of equal sets: its id is a hash of the set, its document the smallest one
    first = (F.any_value(c).alias(c) for c in ("n", "bands", "sketch"))
    reps = stored(linked.groupBy("id").agg(F.min("doc").alias("doc"), *first), "reps")
    wide, rows = rows, stored(rows.select("doc", "n", "id"), "rows")  # bands and sketches are in reps now
    discard(wide)
    linked = rows.where("n > 0 and doc is not null")
    entries = table_entries(reps, bands)
    asked = stored(entries.select("id").distinct(), "asked")
    met = stored(reps.join(keys_of(asked, "id"), "id", "left_semi").select("id", "n", "sketch", "doc"), "met", prune=True)
    texts = docs.join(keys_of(met, "doc").select("doc"), "doc", "left_semi")
    sets = stored(full_sets(texts, "text", words), "sets", prune=True)
    # rows that repeat, and other texts of an id that was asked for
    times = linked.groupBy("id", "doc").agg(F.count("*").alias("times")).where("times > 1")
    if not times.isEmpty() or not linked.groupBy("doc").agg(F.count_distinct("id").alias("texts")).where("texts > 1").isEmpty():
        sets = stored(sets.dropDuplicates(["id"]).join(met.select("id"), "id", "left_semi"), "sets")
    temporary = [rows, reps, met, sets, entries, asked]

    def kept(df: DataFrame, tag: str) -> DataFrame:
        temporary.append(stored(df, tag))
        return temporary[-1]

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def links(proposed: DataFrame) -> DataFrame:
        temporary.append(stored(verified(proposed, sets, percent), "links", prune=True))
        return temporary[-1]

    def open_entries(where: DataFrame, links_: DataFrame) -> DataFrame:
        """Entries of buckets with several components, and each bucket's largest one."""
        found = components(links_)
        temporary.append(found)
        sized = found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component")
        named = where.join(sized, "id", "left").select("key", "i", "id", F.coalesce("component", "id").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
        main = F.max(F.struct("size", "c"))["c"].alias("main")
        drawn = F.min_by("id", F.xxhash64("id", "key"))
        several = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("in_bucket"), main).where("lo <> hi").select("key", "main", "in_bucket")
        inner = named.join(several, "key")
        leader = inner.where("c = main").groupBy("key").agg(drawn.alias("leader"))
        return kept(inner.join(leader, "key").select("key", "i", "id", "c", "main", "leader", "in_bucket"), "open")

    lows = entries.where("id <> low").groupBy("id", "low").agg(F.count("*").alias("tables"))
    lows = lows.groupBy("id").agg(F.min("low").alias("least"), F.max_by("low", F.struct("tables", -F.col("low"))).alias("best"))
    star = kept(agreeing(ordered(lows.select(F.col("id").alias("a"), F.explode(F.array("least", "best")).alias("b"))), met, percent, bands), "proposals")
    one = links(star)
    linked_pairs = one
    some = open_entries(entries, one)
    if not some.isEmpty():
        outside = F.col("c") != F.col("main")
        several = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("id", "leader"), "leader"))), 1, DRAWN)  # of halves * span at most
        drawn = some.where(outside).groupBy("id").agg(several.alias("l"))
        drawn = ordered(drawn.select(F.col("id").alias("a"), F.explode("l.leader").alias("b")))
        drawn = kept(agreeing(drawn.join(star, ["a", "b"], "left_anti"), met, percent, bands), "proposals")
        linked_pairs = one.unionByName(links(drawn))
        left_over = open_entries(some.select("key", "i", "id"), linked_pairs)
        small, large = left_over.where(F.col("in_bucket") <= SMALL), left_over.where(F.col("in_bucket") > SMALL)
        few = small.where("c <> main").select("key", F.col("id").alias("a"), F.col("c").alias("ca"))
        every = small.select("key", F.col("id").alias("b"), F.col("c").alias("cb"), "main")
        more = ordered(few.join(every, "key").where("ca <> cb and (cb = main or a < b)").select("a", "b"))
        more = kept(agreeing(more.join(star.unionByName(drawn), ["a", "b"], "left_anti"), met, percent, bands), "proposals")
        linked_pairs = linked_pairs.unionByName(links(more))
        if not large.isEmpty():
            linked_pairs = linked_pairs.unionByName(block_links(large, met, sets, percent, bands))
    over = components(linked_pairs)
    temporary.append(over)
    over = over.join(reps.select("id", "doc"), "id")
    least = over.groupBy("component").agg(F.min("doc").alias("component_id"))
    joined = over.join(least, "component").select("id", "component_id")
    times = linked.groupBy("id").agg(F.count("*").alias("n"))
    classes = stored(reps.select("id", "doc").join(times, "id").join(joined, "id", "left").select("id", "n", F.coalesce("component_id", "doc").alias("component_id")), "classes")
    able = (F.col("n") > 0) & F.col("doc").isNotNull()
    narrow = rows.select("doc", F.col("n").alias("n_shingles"), able.alias("able"), F.when(able, F.col("id")).otherwise(F.xxhash64("doc")).alias("id"))
    joined = spread_join(narrow, classes, ["id"], ["doc"], rows.count())
    found = stored(joined.select("doc", "n_shingles", F.when(F.col("able"), F.col("component_id")).otherwise(F.col("doc")).alias("component_id")), "components")
    for old in (*temporary, classes):
        discard(old)
    return found.select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))
