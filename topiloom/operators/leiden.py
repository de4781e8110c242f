"""The Leiden method (Traag, Waltman, van Eck 2019) for one graph in memory.

Quality is the Reichardt-Bornholdt one with the configuration null model: the gain of
node i in community c is w_ic - g * k_i * K_c / 2m.  Fast local moving with a queue,
refinement inside communities, aggregation, until nothing moves.
"""

from __future__ import annotations

from collections import deque

import numpy as np


class _Graph:
    """Adjacency in compressed rows; ``loops`` are weights inside a node."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, loops: np.ndarray | None = None):
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        w = np.concatenate([weight, weight])
        order = np.argsort(a, kind="stable")
        self.n, self.to, self.w = n, b[order].tolist(), w[order].tolist()
        self.at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist()
        self.loops = np.zeros(n) if loops is None else loops
        self.strength = (np.bincount(a, weights=w, minlength=n) + 2 * self.loops).tolist()

    def around(self, i: int, label: list[int]) -> dict[int, float]:
        out: dict[int, float] = {}
        for e in range(self.at[i], self.at[i + 1]):
            c = label[self.to[e]]
            out[c] = out.get(c, 0.0) + self.w[e]
        return out


def _move(g: _Graph, label: list[int], factor: float, rng: np.random.Generator) -> bool:
    total = [0.0] * g.n
    for i, c in enumerate(label):
        total[c] += g.strength[i]
    empty = [c for c in range(g.n) if total[c] == 0.0]
    queue = deque(rng.permutation(g.n).tolist())
    queued = [True] * g.n
    moved = False
    while queue:
        i = queue.popleft()
        queued[i] = False
        own, k = label[i], g.strength[i]
        total[own] -= k
        around = g.around(i, label)
        best, gain = own, around.get(own, 0.0) - factor * k * total[own]
        for c, w in around.items():
            value = w - factor * k * total[c]
            if value > gain + 1e-12 or (abs(value - gain) <= 1e-12 and c == own):
                best, gain = c, value
        if gain < -1e-12 and empty:  # better alone
            best = empty.pop()
        total[best] += k
        if best != own:
            label[i] = best
            moved = True
            if total[own] <= 1e-12:
                empty.append(own)
            for e in range(g.at[i], g.at[i + 1]):
                j = g.to[e]
                if label[j] != best and not queued[j]:
                    queued[j] = True
                    queue.append(j)
    return moved


def _refine(g: _Graph, label: list[int], factor: float, rng: np.random.Generator) -> list[int]:
    """Splits each community into well-connected parts: single nodes merge only inside it."""
    part = list(range(g.n))
    total = list(g.strength)
    size = [1] * g.n
    for i in rng.permutation(g.n).tolist():
        if size[part[i]] > 1:
            continue
        own, k = part[i], g.strength[i]
        around: dict[int, float] = {}
        for e in range(g.at[i], g.at[i + 1]):
            j = g.to[e]
            if label[j] == label[i]:
                around[part[j]] = around.get(part[j], 0.0) + g.w[e]
        best, gain = own, 0.0
        for c, w in around.items():
            value = w - factor * k * total[c] if c != own else 0.0
            if value > gain + 1e-12:
                best, gain = c, value
        if best != own:
            part[i] = best
            total[best] += k
            total[own] -= k
            size[best] += 1
            size[own] -= 1
    return part


def leiden(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Labels of n nodes, numbered by falling size, then by the first member."""
    rng = np.random.default_rng(seed)
    g = _Graph(n, src, dst, weight)
    twice = sum(g.strength)
    factor = resolution / twice if twice else 0.0
    member = np.arange(n)  # node of the current graph for each original node
    label = list(range(n))
    while True:
        moved = _move(g, label, factor, rng)
        final = np.array(label)[member]
        if not moved:
            break
        part = _refine(g, label, factor, rng)
        names, place = np.unique(np.array(part), return_inverse=True)
        if len(names) == g.n:
            break
        # parts become nodes, which start in the communities that they come from
        owner = np.empty(len(names), dtype=np.int64)
        owner[place] = label
        rows = np.repeat(np.arange(g.n), np.diff(g.at))
        a, b, w = place[rows], place[np.array(g.to, dtype=np.int64)], np.array(g.w)
        upper = a < b
        key = a[upper] * len(names) + b[upper]
        pairs, where = np.unique(key, return_inverse=True)
        merged = np.bincount(where, weights=w[upper]) if len(pairs) else np.zeros(0)
        inner = np.bincount(a[a == b], weights=w[a == b], minlength=len(names)) / 2 + np.bincount(place, weights=g.loops, minlength=len(names))
        g = _Graph(len(names), pairs // len(names), pairs % len(names), merged, inner)
        _, start = np.unique(owner, return_inverse=True)
        label = start.tolist()
        member = place[member]
    return by_size(final)


def by_size(label: np.ndarray) -> np.ndarray:
    _, first, inverse, count = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -count))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[inverse]
