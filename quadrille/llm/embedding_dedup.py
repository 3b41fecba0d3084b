"""Embedding near-duplicates with an HNSW graph per shard.

1. Vectors are dealt to shards of bounded size by a hash of their id. Within a shard they are gathered
   into caps: a centre and the vectors within half the link angle of it, so that every two vectors
   of a cap are linked whatever their number. A group of near copies thus becomes a few caps with counts.
2. Each shard's cap centres get an HNSW graph. Its beam is widened until an audit against brute force
   finds every neighbour of the sampled centres. Graph and centres are written once to the shared folder;
   rows carry their URI, so that what is shuffled is in proportion to the shards and not to their vectors.
3. The centres query every shard, their own included, block by block. Each block is audited too: sampled
   centres of it are held against all centres of the shard, and the beam is widened until none is missed.
   Two caps whose angle and radii prove that all or none of their vectors are linked are settled as a
   whole; in the other pairs, vectors are compared with vectors in blocks. All comparisons that decide are
   made in double precision.
4. Linked caps are united to components.

So n_links counts every linked pair found without listing the pairs of a group.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without an id, link with nothing and are their own component; vectors of different lengths are never
compared; lengths go up to 2^22; repeated rows are separate vectors; an empty table gives no rows.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, discard_path, fresh_path, stored
from .components import components
from .hnsw import Hnsw
from .shared_files import new_file, opened

SHARD_ROWS, LEAST_SHARDS = 16_000, 8
#: Centres in a query block and vectors in a comparison block.
BLOCK = 2048
BEAM, AUDITED, RECALL = 24, 64, 0.999
#: Centres of a query block that are audited against all of a shard.
ASKED = 32
#: Ids are made of vector length, shard and place in the shard: 22, 20 and 21 bits.
PLACE_BITS, SHARD_BITS = 21, 20
#: Radians by which a proof by angles must hold; what lies within is compared in full.
SLACK = 1e-6

SHARD_OUT = "kind string, shard long, uid long, vec_id long, cap long, vector binary, radius double, members long, first_id long, uri string"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Few rows in an Arrow batch, for tables whose rows are whole blocks; only around eager steps."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gather_caps(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal unit vectors to caps: (cap of each vector, centres, radius of each cap).

    A first pass makes each vector that no leader covers a leader. Then the caps with several vectors,
    largest first, move their centre to the mean and take all vectors such caps hold that it covers, so
    a round group ends up in one cap rather than in those of chance leaders.
    """
    n = len(x)
    cover = math.cos(radius)
    owner = np.full(n, -1, dtype=np.int64)
    leaders: list[int] = []
    for at in range(0, n, BLOCK):
        block = np.arange(at, min(n, at + BLOCK))
        if leaders:
            s = x[block] @ x[leaders].T
            best = s.argmax(axis=1)
            hit = s[np.arange(len(block)), best] >= cover
            owner[block[hit]] = best[hit]
        left = block[owner[block] < 0]
        near = x[left] @ x[left].T >= cover
        for i, node in enumerate(left.tolist()):
            if owner[node] < 0:
                fresh = left[near[i] & (owner[left] < 0)]
                owner[fresh] = len(leaders)
                leaders.append(node)
    sizes = np.bincount(owner, minlength=len(leaders))
    several = np.flatnonzero(sizes[owner] > 1)
    cap = np.full(n, -1, dtype=np.int64)
    centres: list[np.ndarray] = []
    for lead in np.argsort(-sizes, kind="stable").tolist():
        if sizes[lead] < 2:
            break
        own = several[(owner[several] == lead) & (cap[several] < 0)]
        while len(own):
            middle = x[own].mean(axis=0)
            middle /= np.linalg.norm(middle)
            free = several[cap[several] < 0]
            taken = free[x[free] @ middle >= cover]
            if not len(np.intersect1d(taken, own)):
                middle, taken = x[own[0]], own[:1]
            cap[taken] = len(centres)
            centres.append(middle)
            own = own[cap[own] < 0]
    for node in np.flatnonzero(cap < 0).tolist():
        cap[node] = len(centres)
        centres.append(x[node])
    middles = np.array(centres) if centres else np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, middles[cap]), -1, 1)) if n else np.zeros(0)
    alone = np.bincount(cap, minlength=len(middles))[cap] == 1
    reach = np.zeros(len(middles))
    np.maximum.at(reach, cap, np.where(alone, 0.0, angle))
    return cap, middles, reach


def audited_beam(graph: Hnsw, x: np.ndarray, wide: float, beam: int = BEAM) -> int:
    """Smallest doubling of ``beam`` at which sampled centres find all their neighbours within the
    search cone, themselves included. A beam as wide as the shard is exhaustive, so this ends."""
    n = len(x)
    picked = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(np.int64))
    truth = x[picked] @ x.T >= wide
    while beam < n:
        ids, _ = graph.search(x[picked], beam)
        hit = np.zeros_like(truth)
        np.put_along_axis(hit, np.where(ids >= 0, ids, picked[:, None]), True, axis=1)
        if (truth & hit).sum() >= RECALL * truth.sum():
            break
        beam *= 2
    return min(beam, n)


def write_shard(folder: str, graph: Hnsw, caps: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez(out, graph=np.frombuffer(graph.to_bytes(), dtype=np.uint8), caps=caps, centres=centres, radius=radius)
    with new_file(folder, ".npz") as (uri, stream):
        stream.write(out.getvalue())
    return uri


def read_shard(uri: str) -> tuple[Hnsw, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, cap ids, centres and radii of a shard."""
    system, path = opened(uri)
    with system.open_input_file(path) as file, np.load(io.BytesIO(file.read())) as a:
        return Hnsw.from_bytes(a["graph"].tobytes()), a["caps"], a["centres"], a["radius"]


def asked_pairs(graph: Hnsw, own: np.ndarray, q: np.ndarray, wide: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``q``, row of ``own``) that a search of the graph finds.

    A query whose whole beam lies within its cone goes on with a wider one. Sampled queries are held
    against all rows; as long as one of them misses a row within its cone, all are asked again with a
    beam twice as wide. A beam as wide as the shard is exhaustive, so this ends.
    """
    n = len(own)
    picked = np.unique(np.linspace(0, len(q) - 1, min(len(q), ASKED)).astype(np.int64))
    truth = q[picked] @ own.T >= wide[picked, None]
    while True:
        found, todo, width = [], np.arange(len(q)), beam
        while len(todo):
            ids, sims = graph.search(q[todo], width)
            full = (sims[:, -1] >= wide[todo] - 1e-4) & (ids[:, -1] >= 0) & (width < n)
            row, col = np.nonzero((ids >= 0) & ~full[:, None])
            found.append((todo[row], ids[row, col].astype(np.int64)))
            todo, width = todo[full], min(n, width * 2)
        a, b = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, dtype=np.int64) for j in (0, 1))
        hit = np.zeros_like(truth)
        at = np.searchsorted(picked, a)
        seen = (at < len(picked)) & (picked[np.minimum(at, len(picked) - 1)] == a)
        hit[at[seen], b[seen]] = True
        if beam >= n or not (truth & ~hit).any():
            return a, b
        beam = min(n, beam * 2)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """id_col, n_links, component_id, kept for every row."""
    spark = table.sparkSession
    theta = math.acos(cosine)
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v"))
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("fit", F.coalesce(F.col("vec_id").isNotNull() & fit, F.lit(False)))
    count = rows.where("fit").count()
    shards = max(LEAST_SHARDS, -(-count // SHARD_ROWS))
    folder = fresh_path(spark, "graphs")
    shard = F.shiftleft(F.size("v").cast("long"), SHARD_BITS) + F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["shard"].iloc[0])
        part = part.sort_values("vec_id", kind="stable")
        x = np.stack(part["v"].to_list()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = part["vec_id"].to_numpy()
        cap, middles, reach = gather_caps(x, theta / 2 - SLACK)
        graph = Hnsw.build(middles)
        wide = math.cos(min(math.pi, theta + 2 * float(reach.max(initial=0)) + SLACK))
        beam = audited_beam(graph, middles, wide)
        base = number << PLACE_BITS
        members = np.bincount(cap, minlength=len(middles))
        first = np.full(len(middles), np.iinfo(np.int64).max)
        np.minimum.at(first, cap, ids)
        rows = pd.DataFrame({"kind": "row", "uid": base + np.arange(len(ids)), "vec_id": ids, "cap": base + cap, "vector": [v.tobytes() if members[c] > 1 else None for v, c in zip(x, cap, strict=True)]})
        caps = pd.DataFrame({"kind": "cap", "cap": base + np.arange(len(middles)), "vector": [v.tobytes() for v in middles], "radius": reach, "members": members, "first_id": first})
        uri = write_shard(folder, graph, base + np.arange(len(middles)), middles, reach)
        # of an index row: members is its centres, first_id the beam
        index = pd.DataFrame({"kind": ["index"], "uri": [uri], "radius": [float(reach.max(initial=0))], "members": [len(middles)], "first_id": [beam]})
        frames = []
        for frame in (rows, caps, index):
            # nullable integers before they meet: ids must not pass through floats
            for c in ("uid", "vec_id", "cap", "members", "first_id"):
                frame[c] = frame[c].astype("Int64") if c in frame else pd.array([None] * len(frame), dtype="Int64")
            frame["shard"] = number
            frames.append(frame.reindex(columns=[c.split()[0] for c in SHARD_OUT.split(", ")]))
        return pd.concat(frames, ignore_index=True)

    fitting = rows.where("fit").select("vec_id", "v", shard.alias("shard"))
    made = stored(fitting.groupBy("shard").applyInPandas(build, SHARD_OUT), "shards")

    # every block of centres asks its own shard and the later ones of its vector length
    caps = made.where("kind = 'cap'").select("shard", "cap", "vector", "radius", "members", "first_id")
    index = made.where("kind = 'index'").select("shard", "uri", F.col("members").alias("centres"), F.col("first_id").alias("beam"), F.col("radius").alias("widest"))
    last = F.shiftleft(F.shiftright("shard", SHARD_BITS), SHARD_BITS) + (shards - 1)
    sent = index.select(F.col("shard").alias("source"), F.col("uri").alias("from_uri"), F.explode(F.sequence(F.lit(0), F.floor((F.col("centres") - 1) / BLOCK).cast("int"))).alias("block"), F.sequence("shard", last).alias("to"))
    sent = sent.select("source", "from_uri", "block", F.explode("to").alias("shard"))
    asked = sent.join(index, "shard").select("source", "shard", "from_uri", "block", "uri", "beam", "widest")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}  # the shard asked and the one that asks

        def shard_of(uri: str, other: str) -> tuple:
            for old in set(held) - {uri, other}:
                del held[old]
            if uri not in held:
                held[uri] = read_shard(uri)
            return held[uri]

        for batch in batches:
            for r in batch.to_pylist():
                graph, own_caps, own, own_radius = shard_of(r["uri"], r["from_uri"])
                part = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
                _, q_caps, q, q_radius = (x if i == 0 else x[part] for i, x in enumerate(shard_of(r["from_uri"], r["uri"])))
                cone = theta + q_radius + r["widest"] + SLACK
                wide = np.cos(np.minimum(math.pi, cone))
                a, b = asked_pairs(graph, own, q, wide, r["beam"])
                if r["source"] == r["shard"]:
                    keep = own_caps[b] > q_caps[a]
                    a, b = a[keep], b[keep]
                cos = np.einsum("ij,ij->i", q[a], own[b])
                angle = np.arccos(np.clip(cos, -1, 1))
                reach = q_radius[a] + own_radius[b]
                exact = reach == 0
                all_ = np.where(exact, cos >= cosine, angle + reach <= theta - SLACK)
                some = ~exact & ~all_ & (angle - reach <= theta + SLACK)
                keep = all_ | some
                yield pa.RecordBatch.from_arrays([pa.array(q_caps[a[keep]]), pa.array(own_caps[b[keep]]), pa.array(all_[keep])], names=["a", "b", "whole"])

    tasks = max(1, min(shards * (shards + 1) // 2, 8 * spark.sparkContext.defaultParallelism))
    dealt = asked.repartition(tasks, "shard", "source", "block").sortWithinPartitions("shard", "source", "block")
    pairs = stored(dealt.mapInArrow(ask, "a long, b long, whole boolean"), "cap-pairs")

    # pairs of caps that only their vectors can decide
    single = caps.where("members = 1").select("cap", "vector")
    vectors = made.where("kind = 'row'").select("uid", "cap", "vector").join(single.select("cap", F.col("vector").alias("w")), "cap", "left").select("uid", "cap", F.coalesce("vector", "w").alias("vector"))
    unsure = stored(pairs.where("not whole").select("a", "b"), "unsure")
    wanted = unsure.select(F.explode(F.array("a", "b")).alias("cap")).distinct()
    piece = F.pmod(F.xxhash64("uid"), F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)))
    blocks = vectors.join(wanted, "cap").join(caps.select("cap", "members"), "cap").groupBy("cap", piece.alias("piece")).agg(F.collect_list(F.struct("uid", "vector")).alias("m"))
    left, right = (blocks.select(F.col("cap").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
    facing = unsure.join(left, "a").join(right, "b").select("a", "b", "ma", "mb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
            s = cell.values
            return s.field("uid").to_numpy(), np.stack([np.frombuffer(v, dtype=np.float64) for v in s.field("vector").to_pylist()])

        for batch in batches:
            for i in range(batch.num_rows):
                (ua, x), (ub, y) = parts(batch.column(2)[i]), parts(batch.column(3)[i])
                hit = x @ y.T >= cosine
                n, m = hit.sum(axis=1), hit.sum(axis=0)
                uid, links = np.concatenate([ua[n > 0], ub[m > 0]]), np.concatenate([n[n > 0], m[m > 0]])
                if len(uid):
                    a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), a)), pa.array(np.full(len(uid), b)), pa.array(uid), pa.array(links.astype(np.int64))], names=["a", "b", "uid", "links"])

    with arrow_rows(spark, 4):
        decided = stored(facing.mapInArrow(compare, "a long, b long, uid long, links long"), "decided")

    whole = pairs.where("whole").select("a", "b")
    both = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = caps.select(F.col("cap").alias("b"), "members")
    by_cap = both.join(size, "b").groupBy("a").agg(F.sum("members").alias("outer")).withColumnRenamed("a", "cap")
    by_row = decided.groupBy("uid").agg(F.sum("links").alias("single"))
    over = components(whole.unionByName(decided.select("a", "b").distinct()))
    united = caps.join(over.withColumnRenamed("id", "cap"), "cap", "left").select("cap", "members", F.coalesce("component", "cap").alias("component"), "first_id")
    firsts = united.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_cap = united.join(firsts, "component").join(by_cap, "cap", "left").select("cap", "component_id", (F.col("members") - 1 + F.coalesce("outer", F.lit(0))).alias("inner"))
    done = made.where("kind = 'row'").select("uid", "vec_id", "cap").join(by_cap, "cap").join(by_row, "uid", "left")
    done = stored(done.select("vec_id", (F.col("inner") + F.coalesce("single", F.lit(0))).alias("n_links"), "component_id"), "linked")
    for old in (made, pairs, unsure, decided, over):
        discard(old)
    discard_path(spark, folder)
    unfit = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return done.unionByName(unfit).select(F.col("vec_id").alias(id_col), "n_links", "component_id", kept)
