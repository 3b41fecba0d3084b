"""Byte-level BPE in two tiers.

A minimal perfect hash (hash and displace, one 128-bit hash per key) resolves every pre-token that
is itself a vocabulary entry; the others are merged with a heap over a doubly linked list of bytes,
lowest rank first and leftmost among equals, which is the order of the reference library. Both tiers
sit behind a bounded memo of pre-tokens. The vocabulary (a bounded file) is read on the driver and
broadcast, so executors need no copy of the file.

Null texts count as empty and give no tokens; texts of any length are encoded whole; repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import map_texts

MEMO_ENTRIES = 400_000
SPAN, SHIFT = 1 << 40, 24


class PerfectHash:
    """Minimal perfect hash over a fixed key set: key -> slot in 0..n-1.

    A key's hash gives a bucket, a start and a step; the bucket's displacement d puts the key at
    start + d * step. Buckets of one key store their slot directly (as a negative number).
    """

    def __init__(self, displacements: np.ndarray, n: int):
        self.displacements, self.n, self.buckets = displacements, n, len(displacements)
        self._table = displacements.tolist()

    @staticmethod
    def parts(key: bytes, buckets: int, n: int) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % buckets, ((h >> 32) & 0xFFFFFFFF) % n, 1 + ((h >> 64) & 0xFFFFFFFF) % max(1, n - 1)

    @classmethod
    def build(cls, keys: list[bytes], per_bucket: float = 2.0) -> PerfectHash:
        n = len(keys)
        buckets = max(1, int(n / per_bucket))
        groups: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]
        for key in keys:
            b, start, step = cls.parts(key, buckets, n)
            groups[b].append((start, step))
        table = np.zeros(buckets, dtype=np.int64)
        taken = bytearray(n)
        order = sorted(range(buckets), key=lambda b: -len(groups[b]))
        for b in order:
            if len(groups[b]) < 2:
                break
            d = 0
            while True:
                slots = {(s + d * t) % n for s, t in groups[b]}
                if len(slots) == len(groups[b]) and not any(taken[x] for x in slots):
                    break
                d += 1
                if d > 50 * n:
                    return cls.build(keys, per_bucket / 2)
            for x in slots:
                taken[x] = 1
            table[b] = d
        free = (x for x in range(n) if not taken[x])
        for b in order:
            if len(groups[b]) == 1:
                table[b] = -next(free) - 1
        return cls(table, n)

    def slot(self, key: bytes) -> int:
        b, start, step = self.parts(key, self.buckets, self.n)
        d = self._table[b]
        return -d - 1 if d < 0 else (start + d * step) % self.n


class Codec:
    """Encodes and decodes with a vocabulary given as tokens in rank order."""

    def __init__(self, tokens: list[bytes], displacements: np.ndarray, slot_rank: np.ndarray, pattern: str):
        import regex

        self.tokens = tokens
        self.ranks = ranks = {t: i for i, t in enumerate(tokens)}
        self.byte_rank = [ranks[bytes([x])] for x in range(256)]
        #: rank of the token that two neighbouring tokens make, by their ids
        self.pairs = {
            a << SHIFT | b: i
            for t, i in ranks.items()
            for cut in range(1, len(t))
            if (a := ranks.get(t[:cut])) is not None and (b := ranks.get(t[cut:])) is not None
        }
        self.hash = PerfectHash(displacements, len(tokens))
        self.slot_rank = slot_rank.tolist()
        self.split = regex.compile(pattern).findall
        codec = self

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                value = self[word] = codec.encode_word(word.encode("utf-8"))
                return value

        self.memo = Memo()

    def lookup(self, word: bytes) -> int:
        """Rank of a whole pre-token, or -1."""
        rank = self.slot_rank[self.hash.slot(word)]
        return rank if self.tokens[rank] == word else -1

    def encode_word(self, word: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        rank = self.lookup(word)
        return rank.to_bytes(4, "little") if rank >= 0 else pack(f"<{len(ids := self.merge(word))}I", *ids)

    def merge(self, word: bytes) -> list[int]:
        """Merge linked bytes, the pair of lowest rank first, the leftmost of equals."""
        n, rank_of = len(word), self.pairs.get
        ids = [self.byte_rank[x] for x in word]
        heap = [r * SPAN + i for i in range(n - 1) if (r := rank_of(ids[i] << SHIFT | ids[i + 1], -1)) >= 0]
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))  # starts of the neighbouring pieces
        ids.append(0)
        while heap:
            r, i = divmod(heappop(heap), SPAN)
            j = after[i]
            # a piece merged into its left neighbour has id -1; a pair that changed has another rank
            if ids[i] < 0 or j >= n or rank_of(ids[i] << SHIFT | ids[j], -1) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank_of(r << SHIFT | ids[k], -1)) >= 0:
                    heappush(heap, q * SPAN + i)
            h = before[i]
            if h >= 0 and (q := rank_of(ids[h] << SHIFT | r, -1)) >= 0:
                heappush(heap, q * SPAN + h)
        ids.pop()
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> bytes:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[tuple[bytes, ...], np.ndarray, np.ndarray]:
    """Tokens in rank order, the perfect hash's displacements, and the rank in each slot."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = tuple(sorted(ranks, key=ranks.__getitem__))
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    made = PerfectHash.build(list(tokens))
    slots = np.zeros(len(tokens), dtype=np.int64)
    for rank, t in enumerate(tokens):
        slots[made.slot(t)] = rank
    return tokens, made.displacements, slots


def codec(path: str, pattern: str) -> Codec:
    tokens, displacements, slots = vocabulary(path)
    return Codec(list(tokens), displacements, slots, pattern)


_held: dict[tuple[str, str], Codec] = {}


def held_codec(tokens: tuple[bytes, ...], displacements: np.ndarray, slots: np.ndarray, pattern: str) -> Codec:
    """A codec that a worker process keeps for its next tasks, with the words it has met; one at a time."""
    key = (hashlib.sha256(displacements.tobytes() + slots.tobytes()).hexdigest(), pattern)
    if key not in _held:
        _held.clear()
        _held[key] = Codec(list(tokens), displacements, slots, pattern)
    return _held[key]


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids`` as little-endian
    unsigned 32-bit integers. Null texts count as empty.
    """
    tokens, displacements, slots = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, displacements, slots))
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def make():
        from quadrille.llm import byte_bpe  # the process's own module: what a function is pickled with does not last

        c = byte_bpe.held_codec(*shared.value, pattern)

        def work(batch: dict) -> dict:
            out: dict = {"id": batch["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for text in batch["text"]:
                ids = c.encode(text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return work

    kind = narrow.schema["id"].dataType.simpleString()
    done = map_texts(narrow, make, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
    return done.withColumnRenamed("id", id_col)
