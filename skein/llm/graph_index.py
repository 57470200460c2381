"""A navigable small-world graph over the vectors of one shard, kept as flat neighbour arrays.

Every step works on a batch of queries at once with array operations: beams advance together, and insertion links a
batch of new vectors by the result of one batched search. Neighbours are chosen by the usual diversity rule, so tight
families stay reachable from elsewhere.
"""

from __future__ import annotations

import numpy as np

LINKS, BUILD_BEAM, SEARCH_BEAM, BATCH = 12, 40, 48, 256


def _dist(vecs: np.ndarray, sq: np.ndarray, q: np.ndarray, qs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.maximum(sq[ids] + qs[:, None] - 2 * np.matmul(vecs[ids], q[:, :, None])[:, :, 0], 0)


def beam(vecs, sq, adj, q, entry, width, expand=2):
    """(ids, squared distances) of the nearest `width` found from the entry points, ascending; -1 and inf where fewer."""
    b = len(q)
    qs = (q * q).sum(1)
    ids = np.full((b, width), -1, np.int32)
    ds = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    e = min(width, entry.shape[1])
    ids[:, :e], ds[:, :e], done[:, :e] = entry[:, :e], _dist(vecs, sq, q, qs, entry[:, :e]), False
    seen = np.zeros((b, len(vecs)), bool)
    seen[np.arange(b)[:, None], ids[:, :e]] = True
    live = np.arange(b)
    while len(live):
        order = np.argsort(done[live], axis=1, kind="stable")[:, :expand]
        open_ = ~np.take_along_axis(done[live], order, 1)
        keep = open_.any(1)
        live, order, open_ = live[keep], order[keep], open_[keep]
        if not len(live):
            break
        at = ids[live[:, None], order]
        done[live[:, None], order] = True
        near, fresh = [], []
        for k in range(order.shape[1]):
            nb = adj[np.maximum(at[:, k], 0)]
            ok = (nb >= 0) & open_[:, k, None]
            nb = np.maximum(nb, 0)
            ok &= ~seen[live[:, None], nb]
            r, c = np.nonzero(ok)
            seen[live[r], nb[r, c]] = True
            near.append(nb)
            fresh.append(ok)
        nb, ok = np.concatenate(near, 1), np.concatenate(fresh, 1)
        d = np.where(ok, _dist(vecs, sq, q[live], qs[live], nb), np.inf)
        all_d = np.concatenate((ds[live], d), 1)
        top = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        ds[live] = np.take_along_axis(all_d, top, 1)
        ids[live] = np.where(np.isfinite(ds[live]), np.take_along_axis(np.concatenate((ids[live], nb), 1), top, 1), -1)
        done[live] = np.take_along_axis(np.concatenate((done[live], ~ok), 1), top, 1)
    return ids, ds


def choose(vecs, ids, ds, links):
    """Of each row's candidates (ascending, -1 for none) keep those nearer to the row's vector than to any kept one; fill up with the nearest rest."""
    b, c = ids.shape
    v = vecs[np.maximum(ids, 0)]
    sq = (v * v).sum(2)
    pair = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    near = np.full((b, c), np.inf, np.float32)
    kept = np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    valid = ids >= 0
    for k in range(c):
        ok = valid[:, k] & (near[:, k] > ds[:, k]) & (count < links)
        kept[ok, k] = True
        count += ok
        near[ok] = np.minimum(near[ok], pair[ok, k])
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * (c + 1) + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(ids, order, 1), -1)
    if out.shape[1] < links:
        out = np.concatenate((out, np.full((b, links - out.shape[1]), -1, out.dtype)), 1)
    return out


def _link_back(vecs, sq, adj, new, chosen):
    """Add the reverse of new -> chosen, pruning full lists by the same rule."""
    src = np.repeat(new, chosen.shape[1])
    dst = chosen.ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    if not len(dst):
        return
    d = ((vecs[src] - vecs[dst]) ** 2).sum(1)
    order = np.lexsort((d, dst))
    src, dst = src[order], dst[order]
    target, first, n = np.unique(dst, return_index=True, return_counts=True)
    most = int(min(n.max(), adj.shape[1]))
    slot = np.arange(len(dst)) - np.repeat(first, n)
    incoming = np.full((len(target), most), -1, np.int32)
    take = slot < most
    incoming[np.repeat(np.arange(len(target)), n)[take], slot[take]] = src[take]
    # peers of one batch may have chosen each other: a neighbour is listed once
    for k in range(most):
        incoming[(adj[target] == incoming[:, k : k + 1]).any(1), k] = -1
    order = np.argsort(incoming < 0, axis=1, kind="stable")
    incoming = np.take_along_axis(incoming, order, 1)
    # lists with room just take them
    used = (adj[target] >= 0).sum(1)
    fits = used + (incoming >= 0).sum(1) <= adj.shape[1]
    r, c = np.nonzero((incoming >= 0) & fits[:, None])
    adj[target[r], used[r] + c] = incoming[r, c]
    target, incoming = target[~fits], incoming[~fits]
    for i in range(0, len(target), 2 * BATCH):
        t = target[i : i + 2 * BATCH]
        cand = np.concatenate((adj[t], incoming[i : i + 2 * BATCH]), 1)
        q = vecs[t]
        dd = np.where(cand >= 0, _dist(vecs, sq, q, sq[t], np.maximum(cand, 0)), np.inf)
        o = np.argsort(dd, axis=1, kind="stable")
        cand, dd = np.take_along_axis(cand, o, 1), np.take_along_axis(dd, o, 1)
        adj[t] = choose(vecs, cand, dd, adj.shape[1])


class Graph:
    """Layers of neighbour arrays: layers[0] holds all vectors, each higher one a geometrically thinner part (by row number)."""

    def __init__(self, vecs: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]):
        self.vecs = np.ascontiguousarray(vecs, np.float32)
        self.sq = (self.vecs * self.vecs).sum(1)
        self.layers, self.members = layers, members

    @classmethod
    def build(cls, vecs: np.ndarray, links: int = LINKS, seed: int = 1) -> Graph:
        """Rows are inserted in a random order; the first of that order make up the higher layers."""
        vecs = np.ascontiguousarray(vecs, np.float32)
        n = len(vecs)
        order = np.random.default_rng(seed).permutation(n)
        sizes = [n]
        while sizes[-1] > 4 * links:
            sizes.append(sizes[-1] // links)
        members = [order[:k] for k in sizes]
        graph = cls(vecs, [], [])
        for level in range(len(sizes) - 1, -1, -1):
            graph.members.insert(0, members[level])
            graph.layers.insert(0, graph._layer(members[level], 2 * links if level == 0 else links))
        return graph

    def _layer(self, rows: np.ndarray, links: int) -> np.ndarray:
        """The neighbour array of a layer, in positions within rows; the layers above serve as its entry."""
        v, sq = self.vecs[rows], self.sq[rows]
        n = len(rows)
        adj = np.full((n, links), -1, np.int32)
        have = min(n, 2 * links)
        self._join(v, sq, adj, np.arange(have), np.zeros((have, 0), np.int32), np.zeros((have, 0), np.float32), links)
        # a layer's rows are a prefix of the order, so positions agree between layers
        while have < n:
            new = np.arange(have, min(n, have + min(BATCH, have)))
            start = self._enter(v[new], have)
            ids, ds = beam(v[:have], sq[:have], adj[:have], v[new], start, BUILD_BEAM)
            self._join(v, sq, adj, new, ids, ds, links)
            have = int(new[-1]) + 1
        return adj

    def _join(self, v, sq, adj, new, ids, ds, links):
        q = v[new]
        peers = np.maximum(sq[new][:, None] + sq[new][None] - 2 * q @ q.T, 0)
        np.fill_diagonal(peers, np.inf)
        k = min(len(new), links // 2 + 4)
        mine = np.argpartition(peers, k - 1, axis=1)[:, :k] if k < len(new) else np.tile(np.arange(len(new)), (len(new), 1))
        pd = np.take_along_axis(peers, mine, 1)
        cand = np.concatenate((ids, np.where(np.isfinite(pd), new[mine], -1).astype(np.int32)), 1)
        dd = np.concatenate((ds, pd), 1)
        o = np.argsort(dd, axis=1, kind="stable")
        cand, dd = np.take_along_axis(cand, o, 1), np.take_along_axis(dd, o, 1)
        # half of a list is chosen; the other half is left for those that choose this vector
        chosen = choose(v, cand, dd, links // 2)
        adj[new, : links // 2] = chosen
        _link_back(v, sq, adj, new, chosen)

    def _enter(self, q: np.ndarray, have: int) -> np.ndarray:
        """Entry points of a layer being built, by descending the finished layers above it."""
        if not self.layers:
            return np.zeros((len(q), 1), np.int32)
        at = self.descend(q, 0)
        return np.zeros((len(q), 1), np.int32) if (at >= have).any() else at

    def descend(self, q: np.ndarray, to: int, width: int = 4) -> np.ndarray:
        """The nearest rows found on layer `to`, starting from the top."""
        at = np.zeros((len(q), 1), np.int32)
        for level in range(len(self.layers) - 1, to - 1, -1):
            rows = self.members[level]
            ids, _ = beam(self.vecs[rows], self.sq[rows], self.layers[level], q, at, width, 1)
            at = _distinct(ids)
        return at

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, squared distances) of the k nearest, ascending; -1 and inf where fewer."""
        q = np.ascontiguousarray(q, np.float32)
        rows = self.members[0]
        v, sq = self.vecs[rows], self.sq[rows]
        out_i, out_d = [], []
        for i in range(0, len(q), BATCH):
            part = q[i : i + BATCH]
            start = self.descend(part, 1) if len(self.layers) > 1 else np.zeros((len(part), 1), np.int32)
            ids, ds = beam(v, sq, self.layers[0], part, start, max(width, k))
            out_i.append(np.where(ids[:, :k] >= 0, rows[np.maximum(ids[:, :k], 0)], -1))
            out_d.append(ds[:, :k])
        return (np.concatenate(out_i), np.concatenate(out_d)) if out_i else (np.zeros((0, k), np.int64), np.zeros((0, k)))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the rows, the sizes and widths of the layers, and all neighbours: everything but the vectors."""
        shape = np.array([x for a in self.layers for x in a.shape], np.int32)
        return self.members[0].astype(np.int32), shape, np.concatenate([a.ravel() for a in self.layers])

    @classmethod
    def from_flat(cls, vecs: np.ndarray, order: np.ndarray, shape: np.ndarray, neighbours: np.ndarray) -> Graph:
        layers, at = [], 0
        for n, w in shape.reshape(-1, 2).tolist():
            layers.append(neighbours[at : at + n * w].reshape(n, w))
            at += n * w
        return cls(vecs, layers, [order[: len(a)] for a in layers])


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Entry points for the next beam: all of them where every row has as many, else the nearest of each row."""
    return ids[:, :1] if (ids < 0).any() else ids
