"""Hierarchical navigable small-world graphs over one shard, searched for many queries at once.

The levels of all nodes are drawn first and the graph is built from the top layer down, in
batches: each batch searches the layer as it stands, picks diverse neighbours among what
it finds and among its own batch, and is linked both ways.
"""

from __future__ import annotations

import pickle

import numpy as np

LINKS, LINKS_0 = 12, 24
BUILD_BEAM, BATCH = 48, 512
CELLS = 1 << 24  # visited marks held at once


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(b, d) and (b, k, d) -> (b, k)."""
    return (x @ q[:, :, None])[:, :, 0]


def _diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Rows of candidates (-1: none) -> m neighbours each: nearest first, skipping any that lies
    nearer to one already picked; places left are filled with the nearest skipped."""
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    k = ids.shape[1]
    ok = ids >= 0
    ok[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    vec = x[np.maximum(ids, 0)]
    between = vec @ vec.transpose(0, 2, 1)
    picked = np.zeros(ids.shape, bool)
    n = np.zeros(len(ids), np.int64)
    for j in range(k):
        near = np.where(picked, between[:, j, :], -2.0).max(1)
        take = ok[:, j] & (n < m) & (near < sims[:, j])
        picked[:, j] = take
        n += take
    rank = np.where(picked, 0, np.where(ok, 1, 2)) * k + np.arange(k)
    best = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(np.where(ok, ids, -1), best, 1)
    if out.shape[1] < m:
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


class Layer:
    def __init__(self, x: np.ndarray, links: int):
        self.x, self.links = x, links
        self.near = np.full((len(x), links), -1, np.int32)

    def beam(self, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best ef nodes found for each query (ids, similarities), and what was visited."""
        n, b = len(self.x), len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n), bool)
        entry = entry.reshape(b, -1)
        ids = np.full((b, max(ef, entry.shape[1])), -1, np.int64)
        sims = np.full(ids.shape, -2.0, np.float32)
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = _dots(q, self.x[entry])
        seen[rows, entry] = True
        done = np.zeros(ids.shape, bool)
        live = np.arange(b)
        while len(live):
            left = np.where(done[live] | (ids[live] < 0), -3.0, sims[live])
            width = min(4, left.shape[1])
            top = np.argpartition(-left, width - 1, axis=1)[:, :width]
            good = np.take_along_axis(left, top, 1) > -3.0
            more = good.any(1)
            live, top, good = live[more], top[more], good[more]
            if not len(live):
                break
            at = live[:, None]
            done[at, top] |= good
            node = np.where(good, ids[at, top], -1)
            nb = np.where(node[:, :, None] >= 0, self.near[np.maximum(node, 0)], -1).reshape(len(live), -1).astype(np.int64)
            nb.sort(axis=1)
            fresh = nb >= 0
            fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            fresh &= ~seen[at, np.maximum(nb, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], nb[r, c]] = True
            s = np.where(fresh, _dots(q[live], self.x[np.maximum(nb, 0)]), np.float32(-2.0))
            all_s = np.concatenate([sims[live], s], 1)
            all_i = np.concatenate([ids[live], np.where(fresh, nb, -1)], 1)
            all_d = np.concatenate([done[live], np.zeros(nb.shape, bool)], 1)
            keep = np.argpartition(-all_s, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[live], sims[live], done[live] = (np.take_along_axis(z, keep, 1) for z in (all_i, all_s, all_d))
        return ids, sims, seen

    def insert(self, new: np.ndarray, found: np.ndarray) -> None:
        """Link new nodes to diverse ones of those found and of each other, both ways."""
        x = self.x
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -2.0)
        k = min(BUILD_BEAM, len(new))
        mates = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.concatenate([found, np.where(np.take_along_axis(own, mates, 1) > -2.0, new[mates], -1)], 1)
        ids[ids == new[:, None]] = -1
        sims = np.where(ids >= 0, _dots(x[new], x[np.maximum(ids, 0)]), -2.0)
        self.near[new] = _diverse(sims, ids, x, self.links)
        src = np.repeat(new, self.links)
        dst = self.near[new].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((-np.einsum("nd,nd->n", x[src], x[dst]), dst))
        src, dst = src[order], dst[order]
        node, start, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(min(count.max(initial=0), 2 * self.links))  # the nearest of those that came
        come = np.full((len(node), width), -1, np.int64)
        within = np.arange(len(dst)) - np.repeat(start, count)
        ok = within < width
        come[np.repeat(np.arange(len(node)), count)[ok], within[ok]] = src[ok]
        ids = np.concatenate([self.near[node].astype(np.int64), come], 1)
        for a in range(0, len(node), BATCH):
            i = ids[a : a + BATCH]
            s = np.where(i >= 0, _dots(x[node[a : a + BATCH]], x[np.maximum(i, 0)]), -2.0)
            self.near[node[a : a + BATCH]] = _diverse(s, i, x, self.links)


class Graph:
    """x: unit vectors (float32)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        n = len(x)
        self.ef, self.links = 32, None
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # upper nodes first
        self.x = np.ascontiguousarray(x[self.order])
        level = level[self.order]
        self.layers: list[Layer] = []
        for top in range(level.max(initial=0), -1, -1):
            size = int((level >= top).sum())
            if top and size < 64:
                continue
            self._build(Layer(self.x[:size], LINKS_0 if top == 0 else LINKS))

    def _build(self, layer: Layer) -> None:
        n = len(layer.x)
        if not self.layers:
            n0 = min(n, BATCH)
            layer.insert(np.arange(n0), np.full((n0, 1), -1, np.int64))
            at = n0
            upper = []
        else:
            at, upper = 0, self.layers
        while at < n:
            new = np.arange(at, min(n, at + min(BATCH, max(64, at))))
            if at:
                entry = self._entry(layer.x[new], upper, min(at, 4)) if upper and at >= len(upper[-1].x) else np.tile(np.arange(min(at, 8)), (len(new), 1))
                found, _, _ = layer.beam(layer.x[new], entry, BUILD_BEAM)
            else:
                found = np.full((len(new), 1), -1, np.int64)
            layer.insert(new, found)
            at = new[-1] + 1
        self.layers.append(layer)

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the base layer in both directions: offsets and nodes."""
        if self.links is None:
            near = self.layers[-1].near
            a = np.repeat(np.arange(len(near)), near.shape[1])
            b = near.reshape(-1).astype(np.int64)
            a, b = a[b >= 0], b[b >= 0]
            key = np.unique(np.concatenate([a * len(near) + b, b * len(near) + a]))
            self.links = np.searchsorted(key // len(near), np.arange(len(near) + 1)), key % len(near)
        return self.links

    @staticmethod
    def _entry(q: np.ndarray, layers: list[Layer], width: int) -> np.ndarray:
        """Go down the layers, each begun from the best of the one above."""
        at = np.tile(np.arange(min(8, len(layers[0].x))), (len(q), 1))
        for layer in layers:
            ids, sims, _ = layer.beam(q, at, 8)
            best = np.argsort(-sims, axis=1)[:, :width]
            at = np.maximum(np.take_along_axis(ids, best, 1), 0)
        return at

    def within(self, q: np.ndarray, least: float, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found with similarity of at least ``least``.

        Where a whole beam lies within, it is widened: from all of it, by the links to and from
        nodes within, until no new one is met.  A beam of the whole shard is a plain scan."""
        ef = ef or self.ef
        if ef >= len(self.x):
            found = [np.nonzero(q[a : a + 256] @ self.x.T >= least) for a in range(0, len(q), 256)]
            return np.concatenate([r + 256 * i for i, (r, _) in enumerate(found)] or [np.zeros(0, np.int64)]), np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)])
        base, out = self.layers[-1], []
        step = max(1, min(1024, CELLS // max(1, len(base.x))))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            entry = self._entry(part, self.layers[:-1], 4) if len(self.layers) > 1 else np.tile(np.arange(min(8, len(base.x))), (len(part), 1))
            ids, sims, seen = base.beam(part, entry, ef)
            r, c = np.nonzero((sims >= least) & (ids >= 0))
            node = ids[r, c]
            out.append((r + a, node))
            wide = np.flatnonzero(((sims >= least) | (ids < 0)).all(1) & (ids >= 0).any(1))
            if not len(wide):
                continue
            seen[wide] = False
            seen[r, node] = True
            mine = np.isin(r, wide)
            r, node = r[mine], node[mine]
            while len(r):
                nr, nn = [], []
                offsets, linked = self._both_ways()
                for b in range(0, len(r), 1 << 14):
                    some = node[b : b + (1 << 14)]
                    count = offsets[some + 1] - offsets[some]
                    rr = np.repeat(r[b : b + (1 << 14)], count)
                    nb = linked[np.repeat(offsets[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
                    ok = ~seen[rr, nb]
                    key = np.unique(rr[ok].astype(np.int64) * len(base.x) + nb[ok])
                    rr, nb = key // len(base.x), key % len(base.x)
                    seen[rr, nb] = True
                    ok = np.einsum("nd,nd->n", part[rr], base.x[nb]) >= least
                    nr.append(rr[ok])
                    nn.append(nb[ok])
                r, node = np.concatenate(nr), np.concatenate(nn)
                out.append((r + a, node))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    def widen(self) -> bool:
        """A beam twice as wide, or of the whole shard from an eighth of it on; False if it was that already."""
        if self.ef >= len(self.x):
            return False
        self.ef = 2 * self.ef if 8 * self.ef < len(self.x) else len(self.x)
        return True

    def dump(self) -> bytes:
        return pickle.dumps((self.ef, self.order, self.x, [layer.near for layer in self.layers]), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Graph:
        g = cls.__new__(cls)
        g.links = None
        g.ef, g.order, g.x, near = pickle.loads(data)
        g.layers = []
        for links in near:
            layer = Layer.__new__(Layer)
            layer.x, layer.links, layer.near = g.x[: len(links)], links.shape[1], links
            g.layers.append(layer)
        return g
