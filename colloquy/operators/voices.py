"""Clustering of the vectors of one bounded portion, in arrays: what a task does with the rows that Spark dealt to it."""

from __future__ import annotations

import math

import numpy as np

SEED = 42
#: Vectors of a bucket whose neighbours are looked for pair by pair, and how often the vectors are dealt out anew.
LEAF, TREES = 1024, 8
#: Rows whose differences from all their candidates are held at a time.
GAPS = 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    out -= 2 * a @ b.T
    return np.maximum(out, 0, out=out)


def _leaves(x: np.ndarray, dice: np.random.Generator) -> list[np.ndarray]:
    """The rows in buckets of at most LEAF: each half lies on one side of the median along a random direction."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        order = rows[np.argsort(x[rows] @ dice.normal(size=x.shape[1]), kind="stable")]
        todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def _nearest(near: np.ndarray, far: np.ndarray, more: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of what is known and what came, each row as often as once."""
    m = near.shape[1]
    every, dist = np.concatenate([near, more], axis=1), np.concatenate([far, dist], axis=1)
    by_name = np.argsort(every, axis=1, kind="stable")
    every, dist = np.take_along_axis(every, by_name, 1), np.take_along_axis(dist, by_name, 1)
    dist[:, 1:][every[:, 1:] == every[:, :-1]] = np.inf
    best = np.argsort(dist, axis=1, kind="stable")[:, :m]
    return np.take_along_axis(every, best, 1), np.take_along_axis(dist, best, 1)


def neighbours(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row about the m nearest others, -1 where there are fewer: (rows, squared distances).

    Candidates share a bucket in one of several random projections, or are neighbours of neighbours that do; all are ranked
    by exact distance. Exact for at most LEAF rows, which are one bucket.
    """
    n, dice = len(x), np.random.default_rng(SEED)
    near, far = np.full((n, m), -1), np.full((n, m), np.inf)
    for _ in range(1 if n <= LEAF else TREES):
        for rows in _leaves(x, dice):
            d = squared(x[rows], x[rows])
            np.fill_diagonal(d, np.inf)
            k = min(m, len(rows) - 1)
            if k < 1:
                continue
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            near[rows], far[rows] = _nearest(near[rows], far[rows], rows[at], np.take_along_axis(d, at, 1))
    for start in range(0, n if n > LEAF else 0, 128):
        rows = np.arange(start, min(n, start + 128))
        more = near[near[rows, : min(m, 12)]].reshape(len(rows), -1)
        dist = np.empty(more.shape)
        for at in range(0, len(rows), GAPS):
            gap = x[more[at : at + GAPS]]
            gap -= x[rows[at : at + GAPS]][:, None, :]
            np.einsum("ijk,ijk->ij", gap, gap, out=dist[at : at + GAPS])
        dist[more == rows[:, None]] = np.inf
        near[rows], far[rows] = _nearest(near[rows], far[rows], more, dist)
    near[np.isinf(far)] = -1
    return near, far


class Graph:
    """The symmetric graph of nearest neighbours, 1 for a pair that is mutual and 1/2 for another, its rows one after the other."""

    def __init__(self, near: np.ndarray):
        n, held = len(near), near >= 0
        own = np.arange(n)[:, None]
        both = np.empty(2 * np.count_nonzero(held), np.int64)
        both[: len(both) // 2] = (own * n + near)[held]
        both[len(both) // 2 :] = (near * n + own)[held]
        both.sort()
        firsts = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        self.col, self.weight = both[firsts], np.diff(firsts, append=len(both)) / 2
        del both, firsts, held
        row = self.col // n
        self.col %= n
        self.starts = np.searchsorted(row, np.arange(n))
        self.degree = np.add.reduceat(np.append(self.weight, 0.0), self.starts)
        self._alone = np.bincount(row, minlength=n) == 0
        self.degree[self._alone] = 0.0
        self._root = np.sqrt(np.where(self.degree > 0, self.degree, 1.0))
        self._scaled = self._root[row]
        self._scaled *= self._root[self.col]
        np.divide(self.weight, self._scaled, out=self._scaled)

    def times(self, v: np.ndarray) -> np.ndarray:
        """The normalised graph, D^-1/2 W D^-1/2, times the columns of v; a row without neighbours has only itself."""
        sums, links = np.empty(v.shape), np.zeros(len(self.col) + 1)
        for c in range(v.shape[1]):  # column by column: all at once would hold a number for each link and column
            np.take(np.ascontiguousarray(v[:, c]), self.col, out=links[:-1], mode="clip")  # which needs no copy of out
            links[:-1] *= self._scaled
            sums[:, c] = np.add.reduceat(links, self.starts)
        sums[self._alone] = v[self._alone]
        return sums

    def vectors(self, k: int, blocks: int = 10, cycles: int = 40, within: float = 1e-7) -> np.ndarray:
        """The k eigenvectors of the graph's Laplacian with the smallest eigenvalues, divided by the roots of the degrees.

        Lanczos steps on blocks of vectors, kept orthogonal to all before them, so that an eigenvalue that comes several times
        (a graph in several parts) gives all its vectors; restarted from the best found until they hold.
        """
        n = len(self.degree)
        width = min(n, k + 3)
        block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, width)))[0]
        best = block
        for _ in range(cycles):
            base, step = block, block
            for _ in range(blocks - 1):
                step = self.times(step)
                for _ in range(2):
                    step = step - base @ (base.T @ step)
                step, r = np.linalg.qr(step)
                fresh = np.abs(np.diag(r)) > 1e-10
                step = step[:, fresh]
                if not step.shape[1] or base.shape[1] + step.shape[1] > n:
                    break
                base = np.concatenate([base, step], axis=1)
            after = self.times(base)
            values, turn = np.linalg.eigh((base.T @ after + after.T @ base) / 2)
            best, values = base @ turn[:, ::-1][:, :width], values[::-1]
            rest = after @ turn[:, ::-1][:, :k] - best[:, :k] * values[:k]
            del after  # else it would be held through the next cycle's steps
            if np.sqrt((rest**2).sum(0)).max() < within or base.shape[1] >= n:
                break
            block = np.linalg.qr(best)[0]
        return best[:, :k] / self._root[:, None]


def kmeans(x: np.ndarray, k: int, weight: np.ndarray | None = None, starts: int = 8, most: int = 100) -> np.ndarray:
    """Labels of the best of several runs of k-means from seeds that lie apart."""
    w = np.ones(len(x)) if weight is None else weight.astype(float)
    k, best, least = min(k, len(x)), np.zeros(len(x), int), math.inf
    dice, weighed = np.random.default_rng(SEED), np.ascontiguousarray((x * w[:, None]).T)
    for _ in range(starts):
        middles, far = x[[dice.choice(len(x), p=w / w.sum())]], np.full(len(x), math.inf)
        for _ in range(k - 1):
            far = np.minimum(far, squared(x, middles[-1:])[:, 0])  # the others' distances are in it
            d = far * w
            middles = np.concatenate([middles, x[[dice.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]]])
        labels = None
        for _ in range(most):
            new = squared(x, middles).argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            sums = np.stack([np.bincount(labels, component, k) for component in weighed], axis=1)
            n = np.bincount(labels, w, k)
            middles = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], middles)
        cost = float((squared(x, middles).min(1) * w).sum())
        if cost < least - 1e-12:
            best, least = labels, cost
    return best


def spectral(x: np.ndarray, k: int) -> np.ndarray:
    """Labels by k-means of the Laplacian's vectors of the neighbour graph, of 30 neighbours or a tenth of the rows, two others at least."""
    n = len(x)
    if k < 2 or n <= k:
        return np.arange(n) % max(k, 1)
    near = neighbours(x, min(n - 1, max(2, min(30, n // 10) - 1)))[0]
    del x  # what follows has the graph alone, and no vectors besides if the caller holds none
    graph = Graph(near)
    del near
    return kmeans(graph.vectors(k), k)


def ward(n: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    """Labels of clusters, given by their numbers of members and means, after merging until k are left, each time the two whose
    union adds least to the squared distances from the mean. Chains of nearest neighbours find the merges; what is held
    is a number and a mean for each cluster."""
    n, mean = n.astype(float).copy(), mean.astype(float).copy()
    size = len(n)
    if size <= k:
        return np.arange(size)
    live, merges, chain = np.ones(size, bool), [], []
    while len(merges) < size - 1:
        if not chain:
            chain.append(int(np.argmax(live)))
        tip = chain[-1]
        rows = np.flatnonzero(live)
        gap = mean[rows] - mean[tip]
        cost = n[rows] * n[tip] / (n[rows] + n[tip]) * np.einsum("ij,ij->i", gap, gap)
        cost[rows == tip] = np.inf
        at = int(cost.argmin())
        if len(chain) > 1:
            back = int(np.searchsorted(rows, chain[-2]))
            if cost[back] <= cost[at]:
                at = back
        to = int(rows[at])
        if len(chain) > 1 and to == chain[-2]:
            chain = chain[:-2]
            low, high = min(tip, to), max(tip, to)
            merges.append((float(cost[at]), len(merges), low, high))
            mean[low] = (n[low] * mean[low] + n[high] * mean[high]) / (n[low] + n[high])
            n[low] += n[high]
            live[high] = False
        else:
            chain.append(to)
    parent = list(range(size))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, _, a, b in sorted(merges)[: size - k]:
        parent[root(b)] = root(a)
    return np.unique([root(i) for i in range(size)], return_inverse=True)[1]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """The mean over rows of how much nearer the own cluster is than the next; -1 for a single cluster."""
    names = np.unique(labels)
    if len(names) < 2:
        return -1.0
    d = np.sqrt(squared(x, x))
    np.fill_diagonal(d, 0)
    member = labels[None, :] == names[:, None]
    n = member.sum(1)
    mean = d @ member.T.astype(float)
    own = np.searchsorted(names, labels)
    rows = np.arange(len(x))
    inside = mean[rows, own] / np.maximum(n[own] - 1, 1)
    mean = mean / n
    mean[rows, own] = np.inf
    outside = mean.min(1)
    gap = (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300)
    return float(np.where(n[own] > 1, gap, 0.0).mean())


def criterion(x: np.ndarray, labels: np.ndarray, most: int = 100) -> float:
    """The Bayesian information criterion of a mixture of Gaussians with full covariances, fitted from these labels."""
    n, width = x.shape
    names, own = np.unique(labels, return_inverse=True)
    k = len(names)
    part, before = np.eye(k)[own], -math.inf
    for _ in range(most):
        weight = part.sum(0) + 1e-10
        each = np.empty((n, k))
        for c in range(k):
            mean = part[:, c] @ x / weight[c]
            gap = x - mean
            root = np.linalg.cholesky((part[:, c, None] * gap).T @ gap / weight[c] + 1e-6 * np.eye(width))
            z = np.linalg.solve(root, gap.T)
            each[:, c] = np.log(weight[c] / n) - 0.5 * (width * math.log(2 * math.pi) + (z * z).sum(0)) - np.log(np.diag(root)).sum()
        top = each.max(1)
        fit = top + np.log(np.exp(each - top[:, None]).sum(1))
        part = np.exp(each - fit[:, None])
        if abs(fit.mean() - before) < 1e-3:
            break
        before = fit.mean()
    return float((k - 1 + k * width + k * width * (width + 1) // 2) * math.log(n) - 2 * fit.sum())


def decide(silhouettes: dict[int, float], criteria: dict[int, float]) -> int:
    """Two speakers if they are clearly apart, else three, or four where that is much the better model."""
    s, c = (lambda k: silhouettes.get(k, -1.0)), (lambda k: criteria.get(k, math.inf))
    rules = [(s(3) >= s(2) - 0.02 and c(3) < c(2), 3), (s(2) - s(3) > 0.03, 2), (s(3) >= 0, 3), (True, 2)]
    best = next(number for holds, number in rules if holds)
    return 4 if best == 3 and s(4) >= s(3) - 0.02 and c(4) < c(3) * 0.98 else best


def speakers(x: np.ndarray, most: int = 5) -> int:
    """How many speakers: silhouettes (of 500 rows at most) and criteria of 2 to 5 clusters; two for fewer than 100 rows."""
    if len(x) < 100:
        return 2
    some = np.random.default_rng(SEED).permutation(len(x))[:500]
    found = {k: kmeans(x, k, starts=5) for k in range(2, min(most, 5) + 1)}
    return decide({k: silhouette(x[some], v[some]) for k, v in found.items()}, {k: criterion(x, v) for k, v in found.items()})


def speakers_fast(x: np.ndarray, most: int = 4) -> int:
    """The number from 2 to 4 with the best silhouette, of 500 rows at most."""
    top = min(most, 4, len(x) // 10)
    if len(x) < 10 or top < 2:
        return min(2, max(most, 1))
    some = x[np.random.default_rng(SEED).permutation(len(x))[:500]]
    found = {k: silhouette(some, kmeans(some, k, starts=5)) for k in range(2, top + 1)}
    return max(found, key=lambda k: (found[k], -k))
