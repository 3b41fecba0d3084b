"""Quality by co-training of two views.

One classifier sees only a text's content (hashed words and shape), the other only the page's
metadata: source, language, length and layout of the lines. Both are logistic regressions, fitted first
on a bounded sample of labelled rows. In each round every view scores all unlabelled documents, labels
those it is surest of, in the classes' shares, and hands them to the other view's training set; the
surest are found by a top-k on the executors, and only they reach the driver. At the end each view is
calibrated on labelled rows that neither was fitted on, and the calibrated log-odds are added up to score
all documents.

Defined results: null texts count as empty and are scored like any other; null source or language is
a value of its own; repeated rows repeat their score; without labels of both classes every score is
the share of good labels (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, map_texts, stored

#: Bound of the labelled rows that the driver fits on, drawn by a hash of the id.
LABELLED_ROWS = 6_000
CONTENT_BUCKETS, META_BUCKETS = 256, 64
CONTENT_SIZE, META_SIZE = CONTENT_BUCKETS + 8, META_BUCKETS + 8
#: Rounds, and documents that a view hands over in each.
ROUNDS, HANDED = 4, 150
STEPS, RATE, DECAY = 300, 0.5, 1e-3

_token = re.compile(r"\S+")


def content_features(text: str | None) -> np.ndarray:
    """Words of the whole text: hashed endings and marks, and their shape."""
    words = _token.findall(text or "")
    out = np.zeros(CONTENT_SIZE, dtype=np.float32)
    if not words:
        return out
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n = len(words)
    for w, c in counts.items():
        out[zlib.crc32(w[-3:].lower().encode("utf-8")) % CONTENT_BUCKETS] += c / n
    out[:CONTENT_BUCKETS] = np.sqrt(out[:CONTENT_BUCKETS])
    letters = sum(c * sum(map(str.isalpha, w)) for w, c in counts.items())
    chars = sum(c * len(w) for w, c in counts.items())
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper() or w.rstrip("!.,").isupper() and len(w) > 3)
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?\"')")
    out[CONTENT_BUCKETS:] = [1 - letters / chars, upper / n, marked / n, len(counts) / n, max(counts.values()) / n, chars / n / 10, sum(c for w, c in counts.items() if len(w) == 1) / n, 1.0]
    return out


def meta_features(text: str | None, source: str | None, lang: str | None) -> np.ndarray:
    """Source, language, length and line layout; nothing of what the lines say."""
    out = np.zeros(META_SIZE, dtype=np.float32)
    for kind, value in (("s", source), ("l", lang)):
        out[zlib.crc32(f"{kind}{value}".encode()) % META_BUCKETS] += 1
    lines = (text or "").split("\n")
    sizes = [len(x) for x in lines]
    out[META_BUCKETS:] = [np.log1p(sum(sizes)) / 10, np.log1p(len(lines)) / 5, len(set(lines)) / len(lines), np.log1p(max(sizes)) / 10, np.log1p(np.mean(sizes)) / 10, np.std(sizes) / (1 + np.mean(sizes)), sum(s == 0 for s in sizes) / len(lines), 1.0]
    return out


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Linear:
        """Balanced logistic regression by gradient descent on standardised features."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - mean) / scale
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        case = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(STEPS):
            error = case * (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y) / len(y)
            w -= RATE * (z.T @ error + DECAY * w)
            b -= RATE * error.sum()
        return cls(mean, scale, w, b)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -30, 30)


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: (slope, offset) of the log-odds."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        error = p - y
        a -= 0.1 * float((error * odds).mean()) / (1 + float((odds**2).mean()))
        b -= 0.5 * float(error.mean())
    return max(a, 0.0), b


@dataclass
class Model:
    views: list[Linear]
    scales: list[tuple[float, float]]
    prior: float

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        base = np.log(self.prior / (1 - self.prior))
        if not self.views:
            return np.full(len(content), self.prior)
        total = base + sum(a * v.odds(x) + b - base for v, (a, b), x in zip(self.views, self.scales, (content, meta), strict=True))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cotrain(labelled: list[np.ndarray], y: np.ndarray, surest, rounds: int = ROUNDS) -> Model:
    """labelled: a feature matrix for each of the two views. ``surest(views, wanted)`` gives, for each view
    and class, the keys, odds and features of the unlabelled rows it is surest of, surest first."""
    prior = float(min(max(y.mean(), 0.01), 0.99)) if len(y) else 0.5
    check = np.arange(len(y)) % 4 == 3  # calibration rows, never fitted
    if len(set(y[~check].tolist())) < 2:
        return Model([], [], prior)
    sets = [[(x[~check], y[~check])] for x in labelled]
    taken: set[int] = set()
    wanted = {1: max(1, round(HANDED * prior)), 0: max(1, round(HANDED * (1 - prior)))}
    views: list[Linear] = []
    for turn in range(rounds + 1):
        views = [Linear.fit(np.concatenate([x for x, _ in s]), np.concatenate([t for _, t in s])) for s in sets]
        if turn == rounds:
            break
        found = surest(views, wanted, taken)
        for me in (0, 1):
            for label, n in wanted.items():
                # what the other view took in this round is left out, for which there are rows enough
                fresh = [r for r in found.get((me, label), []) if r[0] not in taken][:n]
                taken |= {key for key, _ in fresh}
                if fresh:
                    sets[1 - me].append((np.stack([features[1 - me] for _, features in fresh]), np.full(len(fresh), label)))
    odds = [v.odds(x) for v, x in zip(views, labelled, strict=True)]
    rows = check if len(set(y[check].tolist())) == 2 else np.ones(len(y), dtype=bool)
    return Model(views, [calibrate(o[rows], y[rows]) for o in odds], prior)


def unpacked(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, dtype=np.float16).astype(np.float64)


def surest_rows(pool: DataFrame, views: list[Linear], wanted: dict[int, int], taken: set[int]) -> dict[tuple[int, int], list[tuple[int, tuple]]]:
    """{(view, label): [(key, features of both views)]}: per view and class the surest rows of the pool, by
    a top-k in each task and one over the tasks' rows. Twice and what is taken more than wanted are asked
    for, as the views may choose the same rows."""
    most = {label: 2 * (wanted[1] + wanted[0]) for label in wanted}
    gone = np.array(sorted(taken), dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        best: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = part.column(0).to_numpy()
                cells = [part.column(1).to_pylist(), part.column(2).to_pylist()]
                free = ~np.isin(keys, gone)
                for me in (0, 1):
                    odds = views[me].odds(np.frombuffer(b"".join(cells[me]), dtype=np.float16).reshape(len(keys), -1).astype(np.float64))
                    for label, n in most.items():
                        sure = np.where(free, odds if label else -odds, -np.inf)
                        have = best.setdefault((me, label), {})
                        for i in np.argsort(-sure, kind="stable")[:n]:
                            if sure[i] <= 0:
                                break
                            have[int(keys[i])] = (float(sure[i]), cells[0][i], cells[1][i])
                        if len(have) > 4 * n:
                            best[me, label] = dict(sorted(have.items(), key=lambda x: (-x[1][0], x[0]))[:n])
        rows = [(me, label, k, *v) for (me, label), have in best.items() for k, v in sorted(have.items(), key=lambda x: (-x[1][0], x[0]))[: most[label]]]
        names = ["me", "label", "key", "sure", "content", "meta"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

    tops = stored(pool.mapInArrow(run, "me int, label int, key long, sure double, content binary, meta binary"), "surest")
    out: dict = {}
    for me in (0, 1):
        for label, n in most.items():
            one = tops.where((F.col("me") == me) & (F.col("label") == label)).dropDuplicates(["key"])
            rows = one.orderBy(F.desc("sure"), "key").limit(n).collect()  # a few hundred rows
            out[me, label] = [(r.key, (unpacked(r.content), unpacked(r.meta))) for r in rows]
    discard(tops)
    return out


def learn(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", source_col: str = "source", lang_col: str = "lang") -> Model:
    """Fit the first views on a bounded sample and co-train over all rows without a label; ``training`` is a
    condition on ``labels``."""
    marked = labels.where(training & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).cast("int").alias("y"))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"), docs[lang_col].alias("lang"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1.0, LABELLED_ROWS / max(1, marked.count())) * (1 << 20)
    content, meta, y, ids = [], [], [], []
    for r in featured(rows.join(F.broadcast(marked.where(drawn)), "id"), ("id", "y")).toLocalIterator():  # LABELLED_ROWS, about
        content.append(unpacked(r.content))
        meta.append(unpacked(r.meta))
        y.append(r.y)
        ids.append((r.id is None, r.id or 0, bytes(r.content)))
    order = sorted(range(len(ids)), key=ids.__getitem__)  # the fit does not depend on row order
    if not order:
        return Model([], [], 0.5)
    views, target = [np.stack([v[i] for i in order]) for v in (content, meta)], np.array([y[i] for i in order])
    # features first: if the labels are too many to be broadcast, it is features and no texts that are shuffled
    named = stored(labels.select(labels[id_col].alias("id")).distinct(), "labelled")
    other = featured(rows, ("id",)).join(checked_broadcast(named), "id", "left_anti")
    pool = stored(other.select(F.xxhash64("id", "content", "meta").alias("key"), "content", "meta"), "pool")
    model = cotrain(views, target, lambda v, wanted, taken: surest_rows(pool, v, wanted, taken))
    discard(pool), discard(named)
    return model


def featured(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def work(batch: dict) -> dict:
            out = {c: batch[c] for c in keep}
            out["content"] = [content_features(t).astype(np.float16).tobytes() for t in batch["text"]]
            out["meta"] = [meta_features(t, s, x).astype(np.float16).tobytes() for t, s, x in zip(batch["text"], batch["source"], batch["lang"], strict=True)]
            return out

        return work

    return map_texts(rows.select(*keep, "text", "source", "lang"), make, f"{head}, content binary, meta binary")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """id_col and score (probability of good quality) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"), docs[lang_col].alias("lang"))

    def make():
        def work(batch: dict) -> dict:
            if not batch["id"]:
                return {"id": [], "score": []}
            content = np.stack([content_features(t) for t in batch["text"]]).astype(np.float64)
            meta = np.stack([meta_features(t, s, x) for t, s, x in zip(batch["text"], batch["source"], batch["lang"], strict=True)]).astype(np.float64)
            return {"id": batch["id"], "score": shared.value.score(content, meta).tolist()}

        return work

    return map_texts(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
