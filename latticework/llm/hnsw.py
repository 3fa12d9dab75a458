"""A hierarchical navigable small-world graph over one shard of unit vectors, built and searched many vectors at a time.

Levels fall geometrically; nodes are inserted by falling level, in growing batches. A new node's candidates
at a level are what a beam search of the graph finds there and the other nodes of its batch. Neighbours are
chosen for spread: a candidate is taken if it is nearer to the node than to any neighbour taken before, and places left
over go to the nearest that were passed over; the same rule thins lists that backward edges overfill.
"""

from __future__ import annotations

import numpy as np

NEG = np.float32(-3)  # below any cosine


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first."""
    if ids.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Hnsw:
    def __init__(self, x: np.ndarray, links: int = 12, beam: int = 48, seed: int = 7):
        self.x, self.m = np.ascontiguousarray(x, np.float32), links
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(np.int64), 6)
        order = np.argsort(-level, kind="stable")
        self.level, self.entry = level, int(order[0]) if n else -1
        self.adj = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        at, size = 0, 64
        while at < n:
            self._insert(order[at : at + size], first=at == 0, beam=beam)
            at, size = at + size, min(256, max(64, at + size))

    def _insert(self, batch: np.ndarray, first: bool, beam: int) -> None:
        q = self.x[batch]
        among = q @ q.T
        np.fill_diagonal(among, NEG)
        start = np.full((len(batch), 1), self.entry)
        for k in range(len(self.adj) - 1, -1, -1):
            inside = self.level[batch] >= k
            if first:
                ids, sims = np.full((len(batch), 1), -1), np.full((len(batch), 1), NEG)
            else:
                ids, sims = self.search_level(q, start, k, beam if inside.any() else 4)
                start = ids[:, :4]
            if not inside.any():
                continue
            near = np.where(inside[None, :], among, NEG)[inside]
            own_ids, own_sims = _top(np.broadcast_to(batch, near.shape), near, min(len(batch), 2 * self.m))
            own_ids = np.where(own_sims > NEG, own_ids, -1)
            cand_ids, cand_sims = _top(np.concatenate([ids[inside], own_ids], 1), np.concatenate([sims[inside], own_sims], 1), beam)
            self._connect(batch[inside], cand_ids, cand_sims, k)

    def _spread(self, node: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
        """Neighbours of each node out of its candidates (best first, -1 for none)."""
        rows, width, room = len(node), ids.shape[1], self.adj[k].shape[1]
        room = min(room, width)
        take = np.zeros((rows, width), bool)
        for j in range(width):
            ok = ids[:, j] >= 0
            if j:
                cross = np.einsum("rd,rjd->rj", self.x[ids[:, j]], self.x[ids[:, :j]])
                ok &= ~((cross >= sims[:, j, None]) & take[:, :j]).any(1)
            ok &= take.sum(1) < room
            take[:, j] = ok
        # taken first, then passed over, each best first
        rank = np.argsort(np.where(ids < 0, 2, np.where(take, 0, 1)), axis=1, kind="stable")[:, :room]
        return np.take_along_axis(ids, rank, 1)

    def _connect(self, node: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        adj = self.adj[k]
        got = self._spread(node, ids[:, : 3 * self.m], sims[:, : 3 * self.m], k)
        got = got[:, : self.m] if k == 0 else got  # a new node takes m; level 0 has room for as many backward ones
        adj[node, : got.shape[1]] = got
        src, dst = np.repeat(node, got.shape[1]), got.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, begin, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(begin, count)
        new = np.full((len(to), int(count.max())), -1, np.int64)
        new[np.repeat(np.arange(len(to)), count), place] = src
        both = np.concatenate([adj[to], new], 1).astype(np.int64)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        s = np.where(both >= 0, np.einsum("rd,rjd->rj", self.x[to], self.x[both]), NEG)
        both, s = _top(both, s, both.shape[1])
        full = (both >= 0).sum(1)
        fits = full <= adj.shape[1]
        width = min(adj.shape[1], both.shape[1])
        adj[to[fits], :width] = both[fits, :width]
        over = np.flatnonzero(~fits)
        for at in range(0, len(over), 512):
            part = over[at : at + 512]
            adj[to[part]] = self._spread(to[part], both[part][:, : 2 * adj.shape[1]], s[part][:, : 2 * adj.shape[1]], k)

    def search_level(self, q: np.ndarray, start: np.ndarray, k: int, beam: int, each: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search at one level from the start nodes of each query; ids (-1 for none) and cosines, best first."""
        x, adj, rows = self.x, self.adj[k], len(q)
        seen = np.zeros((rows, len(x) + 1), bool)  # the last column takes -1
        row = np.arange(rows)[:, None]
        start = np.asarray(start, np.int64)
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), NEG, np.float32)
        start_sims = np.where(start >= 0, np.einsum("rd,rjd->rj", q, x[start]), NEG)
        width = min(beam, start.shape[1])
        ids[:, :width], sims[:, :width] = start[:, :width], start_sims[:, :width]
        seen[row, start] = True
        open_ = ids >= 0
        live = np.arange(rows)
        while True:
            some = open_[live].any(1)
            live = live[some]
            if not len(live):
                break
            s, o = sims[live], open_[live]
            pick = np.argsort(np.where(o, -s, 9), axis=1, kind="stable")[:, :each]
            chosen = np.take_along_axis(o, pick, 1)
            from_ = np.where(chosen, np.take_along_axis(ids[live], pick, 1), -1)
            np.put_along_axis(o, pick, False, 1)
            nb = np.where(from_[:, :, None] >= 0, adj[from_], -1).reshape(len(live), -1).astype(np.int64)
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[live[:, None], nb]] = -1
            seen[live[:, None], nb] = True
            r, c = np.nonzero(nb >= 0)
            new = np.full(nb.shape, NEG, np.float32)
            new[r, c] = np.einsum("id,id->i", q[live[r]], x[nb[r, c]])
            all_ids, all_sims = np.concatenate([ids[live], nb], 1), np.concatenate([s, new], 1)
            all_open = np.concatenate([o, nb >= 0], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & (sims[live] > NEG)
        return _top(ids, sims, beam)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry)
        for k in range(len(self.adj) - 1, 0, -1):
            start = self.search_level(q, start, k, 4)[0]
        return self.search_level(q, start, 0, beam)

    def linked(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine about ``least`` or more: what a beam search finds, and what can be reached from there over
        nodes that near, however many there are."""
        none = np.zeros(0, np.int64)
        out = [(none, none)]
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            r, c = self._reached(part, *self.search(part, beam), least)
            out.append((at + r, c))
        return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])

    def _reached(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        n, adj = len(self.x), self.adj[0]
        seen, near = np.zeros((len(q), n + 1), bool), np.zeros((len(q), n), bool)  # the last column takes -1
        seen[np.arange(len(q))[:, None], ids] = True
        seen[:, n] = True
        r, c = np.nonzero((ids >= 0) & (sims >= least))
        front_r, front_c = r, ids[r, c]
        near[front_r, front_c] = True
        while len(front_r):
            next_r, next_c = [], []
            for at in range(0, len(front_r), 8192):  # a bounded number of neighbours at a time
                nb = adj[front_c[at : at + 8192]]
                rows = np.repeat(front_r[at : at + 8192], nb.shape[1])
                fresh = ~seen[rows, nb.ravel()]
                r, c = np.divmod(np.unique(rows[fresh] * n + nb.ravel()[fresh]), n)
                seen[r, c] = True
                for k in range(0, len(r), 65536):
                    a, b = r[k : k + 65536], c[k : k + 65536]
                    good = np.einsum("id,id->i", q[a], self.x[b]) >= least
                    next_r.append(a[good])
                    next_c.append(b[good])
            front_r, front_c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (next_r, next_c))
            near[front_r, front_c] = True
        return np.nonzero(near)

    def scanned(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing all nodes: the last widening."""
        parts = [np.nonzero(q[at : at + 256] @ self.x.T >= least) for at in range(0, len(q), 256)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *[256 * k + r for k, (r, _) in enumerate(parts)]]), np.concatenate([none, *[c for _, c in parts]])
