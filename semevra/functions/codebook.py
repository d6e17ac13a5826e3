"""k-means, the coarse codebook and product quantisation, as driver-side numpy over bounded samples."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

from semevra.functions.hashing import Random

STRIDE = 0x9E3779B9


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, in double precision."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


#: Rows whose distances are held at once: they stay in a core's cache.
BLOCK = 128


def nearest_of(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, the lowest number on ties, by blocks of rows."""
    c = c.astype(np.float64)
    two, norms = np.ascontiguousarray(-2 * c.T), (c * c).sum(1)[None]
    near, served = np.empty(len(x), np.int64), np.empty(len(x))
    d, room = np.empty((BLOCK, len(c))), np.empty((BLOCK, len(c)))
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK].astype(np.float64)
        own, sums = d[: len(part)], room[: len(part)]
        np.matmul(part, two, out=own)
        np.add((part * part).sum(1)[:, None], norms, out=sums)
        own += sums
        n = own.argmin(1)
        near[at : at + BLOCK], served[at : at + BLOCK] = n, own[np.arange(len(part)), n]
    return near, np.maximum(served, 0)


def sums_by(near: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each centroid, in the order of rows."""
    return np.column_stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])])


def plus_plus(x: np.ndarray, k: int, rng: Random) -> np.ndarray:
    """k-means++ seeds in row order; where all distances are 0 seed c is row c mod n."""
    n = len(x)
    rows = [rng.below(n)]
    d = distances(x, x[rows])[:, 0]
    for c in range(1, k):
        total = np.cumsum(d)
        if total[-1] <= 0:
            rows.append(c % n)
        else:
            rows.append(int(min(np.searchsorted(total, rng.float() * total[-1], "right"), n - 1)))
        d = np.minimum(d, distances(x, x[rows[-1:]])[:, 0])
    return x[rows].astype(np.float32).copy()


def kmeans(x: np.ndarray, k: int, iterations: int, seed: int, restarts: int = 8) -> tuple[np.ndarray, float]:
    """(centroids, inertia) of the best restart; an empty cluster takes the worst-served row."""
    best: tuple[np.ndarray, float] | None = None
    k = min(k, len(x))
    for r in range(max(1, restarts)):
        c = plus_plus(x, k, Random(seed + r * STRIDE))
        last = None
        for _ in range(iterations):
            near, served = nearest_of(x, c)
            if last is not None and (near == last).all():
                break
            last = near
            counts = np.bincount(near, minlength=k)
            sums = sums_by(near, x, k)
            for j in range(k):
                if counts[j]:
                    c[j] = sums[j] / counts[j]
                else:
                    w = int(served.argmax())
                    c[j] = x[w]
                    served[w] = 0
        inertia = float(nearest_of(x, c)[1].sum())
        if best is None or inertia < best[1]:
            best = (c, inertia)
    return best


@dataclass(frozen=True)
class Codebook:
    """Coarse centroids (nlist x dim) and PQ codewords (m x 256 x dim/m)."""

    coarse: np.ndarray
    pq: np.ndarray

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    @property
    def m(self) -> int:
        return len(self.pq)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest_of(x, self.coarse)[0].astype(np.int32)

    def encode(self, x: np.ndarray) -> np.ndarray:
        w = self.dim // self.m
        return np.column_stack([nearest_of(x[:, j * w : (j + 1) * w], self.pq[j])[0] for j in range(self.m)]).astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of the query's part j to each codeword of subspace j."""
        w = self.dim // self.m
        return np.array([distances(q[None, j * w : (j + 1) * w], self.pq[j])[0] for j in range(self.m)])

    def rank(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists, nearest first, and their distances."""
        d = distances(q[None], self.coarse)[0]
        order = np.lexsort((np.arange(len(d)), d))
        return order, d[order]


def train(x: np.ndarray, nlist: int, m: int, seed: int, restarts: int = 8) -> Codebook:
    """Coarse lists and the codewords of each subspace, which do not depend on each other and are fitted side by side."""
    w = x.shape[1] // m
    with ThreadPoolExecutor() as pool:
        coarse = pool.submit(kmeans, x, nlist, 25, seed, restarts)
        found = list(pool.map(lambda j: kmeans(np.ascontiguousarray(x[:, j * w : (j + 1) * w]), 256, 20, seed + j, 1)[0], range(m)))
    books = [np.vstack([c, np.repeat(c[-1:], 256 - len(c), 0)]) if len(c) < 256 else c for c in found]
    return Codebook(coarse.result()[0], np.array(books, np.float32))


def probes(dists: np.ndarray, nprobe: int, adaptive: bool, margin: float, cap: int) -> int:
    """Lists to visit: ``nprobe``, and on while the next one is within the margin of the last; never fewer."""
    n = min(nprobe, len(dists))
    if adaptive and n:
        edge = dists[n - 1] * (1 + margin)
        while n < min(len(dists), max(cap, nprobe)) and dists[n] <= edge:
            n += 1
    return n
