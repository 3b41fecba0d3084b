"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

Searches run for many queries in lock step: every step expands the best unexpanded candidates of all
queries at once, so the work is a few array operations a step instead of a Python loop a query.
"""

from __future__ import annotations

import io

import numpy as np

M = 12
BUILD_BEAM = 48
BATCH = 512
QUERIES = 1024


class Hnsw:
    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]):
        """links[l] = (row of each node or -1, neighbours by row); level 0 holds all nodes."""
        self.vectors, self.levels, self.links = vectors, levels, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Hnsw:
        vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(max(1, n))) / np.log(M)).astype(np.int64), 6)[:n]
        if n:
            levels[0] = levels.max()  # the first node is the entry
        links = []
        for level in range(int(levels.max(initial=0)) + 1):
            nodes = np.flatnonzero(levels >= level)
            row = np.full(n, -1, dtype=np.int32)
            row[nodes] = np.arange(len(nodes))
            links.append((row, np.full((len(nodes), 2 * M if level == 0 else M), -1, dtype=np.int32)))
        graph = cls(vectors, levels, links)
        for at in range(0, n, BATCH):
            graph._insert(np.arange(at, min(n, at + BATCH)))
        return graph

    def _insert(self, new: np.ndarray) -> None:
        q = self.vectors[new]
        before = int(new[0])
        entries = np.zeros((len(new), 1), dtype=np.int32)
        near = q @ q.T
        np.fill_diagonal(near, -2)
        for level in range(len(self.links) - 1, -1, -1):
            if before:
                ids, sims = self._beam(q, entries, level, BUILD_BEAM if level <= self.levels[new].max() else 1)
                entries = ids[:, : min(4, ids.shape[1])]
            else:
                ids, sims = np.full((len(new), 1), -1, dtype=np.int32), np.full((len(new), 1), -2, dtype=np.float32)
            here = np.flatnonzero(self.levels[new] >= level)
            if not len(here):
                continue
            mates = np.where(self.levels[new][None, :] >= level, near[here], -2)
            k = min(M, mates.shape[1])
            best = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            pool_ids = np.concatenate([ids[here], new[best].astype(np.int32)], axis=1)
            pool_sims = np.concatenate([np.where(ids[here] >= 0, sims[here], -2), np.take_along_axis(mates, best, 1)], axis=1)
            order = np.argsort(-pool_sims, axis=1)
            pool_ids, pool_sims = np.take_along_axis(pool_ids, order, 1), np.take_along_axis(pool_sims, order, 1)
            row, links = self.links[level]
            back: dict[int, list[int]] = {}
            for i, node in enumerate(new[here].tolist()):
                chosen = self._diverse(pool_ids[i], pool_sims[i])
                links[row[node], : len(chosen)] = chosen
                for c in chosen:
                    back.setdefault(int(c), []).append(node)
            for node, more in back.items():
                have = links[row[node]]
                have = have[have >= 0]
                every = np.unique(np.concatenate([have, np.array(more, dtype=np.int32)]))
                width = links.shape[1]
                if len(every) > width:
                    sims = self.vectors[every] @ self.vectors[node]
                    every = every[np.argsort(-sims)]
                    every = np.array(self._diverse(every, np.sort(sims)[::-1], width), dtype=np.int32)
                links[row[node]] = -1
                links[row[node], : len(every)] = every

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int = M) -> list[int]:
        """Neighbours that are nearer to the node than to one another, filled up with the nearest."""
        ok = (ids >= 0) & (sims > -2)
        ids, sims = ids[ok][: 3 * width], sims[ok][: 3 * width]
        if len(ids) <= width:
            return ids.tolist()
        among = self.vectors[ids] @ self.vectors[ids].T
        chosen: list[int] = [0]
        for i in range(1, len(ids)):
            if among[i, chosen].max() < sims[i]:
                chosen.append(i)
                if len(chosen) == width:
                    break
        rest = [i for i in range(len(ids)) if i not in set(chosen)]
        return ids[chosen + rest[: width - len(chosen)]].tolist()

    def _beam(self, q: np.ndarray, entries: np.ndarray, level: int, width: int, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` nodes found for each query, by falling similarity; -1 fills up."""
        row, links = self.links[level]
        count, n = len(q), len(self.vectors)
        seen = np.zeros((count, n + 1), dtype=bool)
        seen[:, n] = True
        lines = np.arange(count)
        ids = np.full((count, width), -1, dtype=np.int32)
        sims = np.full((count, width), -2.0, dtype=np.float32)
        open_ = np.zeros((count, width), dtype=bool)

        def merge(active: np.ndarray, found: np.ndarray) -> None:
            found = np.where(seen[active[:, None], found], n, found)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = n
            seen[active[:, None], found] = True
            fresh = found < n
            safe = np.where(fresh, found, 0)
            s = np.where(fresh, np.matmul(self.vectors[safe], q[active][:, :, None])[:, :, 0], -2.0)
            all_ids = np.concatenate([ids[active], np.where(fresh, found, -1)], axis=1)
            all_sims = np.concatenate([sims[active], s], axis=1)
            all_open = np.concatenate([open_[active], fresh], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1)

        merge(lines, np.where(entries >= 0, entries, n).astype(np.int64))
        k = min(at_once, width)
        while True:
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                break
            ready = np.where(open_[active], sims[active], -3.0)
            pick = np.argpartition(-ready, k - 1, axis=1)[:, :k]
            valid = np.take_along_axis(open_[active], pick, 1)
            nodes = np.where(valid, np.take_along_axis(ids[active], pick, 1), -1)
            open_[active[:, None], pick] = False
            rows = np.where(nodes >= 0, row[nodes], -1)
            found = np.where(rows[:, :, None] >= 0, links[rows], -1).reshape(len(active), -1)
            merge(active, np.where(found >= 0, found, n).astype(np.int64))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        queries = np.ascontiguousarray(queries, dtype=np.float32)
        width = min(width, len(self.vectors))
        out_ids, out_sims = [], []
        for at in range(0, len(queries), QUERIES):
            q = queries[at : at + QUERIES]
            entries = np.zeros((len(q), 1), dtype=np.int32)
            for level in range(len(self.links) - 1, 0, -1):
                entries = self._beam(q, entries, level, 4)[0]
            ids, sims = self._beam(q, entries, 0, width)
            out_ids.append(ids)
            out_sims.append(sims)
        return np.concatenate(out_ids), np.concatenate(out_sims)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{kind}{i}": a for i, pair in enumerate(self.links) for kind, a in zip(("row", "links"), pair, strict=True)}
        np.savez(out, vectors=self.vectors, levels=self.levels, depth=len(self.links), **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Hnsw:
        with np.load(io.BytesIO(data)) as a:
            return cls(a["vectors"], a["levels"], [(a[f"row{i}"], a[f"links{i}"]) for i in range(int(a["depth"]))])
