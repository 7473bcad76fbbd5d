"""Hierarchical clustering of one block with numpy, and flat cuts of the tree.

A linkage is an ``(n - 1, 4)`` array of (left, right, height, size); nodes below ``n`` are rows, node ``n + k`` is
merge ``k``; heights do not fall (but for centroid and median).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

METHODS = ("single", "complete", "average", "weighted", "ward", "centroid", "median")


def _updated(method: str, da: np.ndarray, db: np.ndarray, dab: float, na: float, nb: float, nk: np.ndarray) -> np.ndarray:
    """Distances of the merged cluster to the others (Lance-Williams)."""
    if method == "single":
        return np.minimum(da, db)
    if method == "complete":
        return np.maximum(da, db)
    if method == "average":
        return (na * da + nb * db) / (na + nb)
    if method == "weighted":
        return (da + db) / 2
    if method == "ward":
        total = na + nb + nk
        return np.sqrt(np.maximum(((na + nk) * da**2 + (nb + nk) * db**2 - nk * dab**2) / total, 0))
    n = na + nb
    if method == "centroid":
        return np.sqrt(np.maximum((na * da**2 + nb * db**2) / n - na * nb * dab**2 / n**2, 0))
    return np.sqrt(np.maximum((da**2 + db**2) / 2 - dab**2 / 4, 0))


def linkage(distances: np.ndarray, method: str = "single") -> np.ndarray:
    """Linkage of a square distance matrix.  Reducible methods follow nearest-neighbour chains (quadratic time); the
    other two look for the closest pair each time."""
    if method not in METHODS:
        raise ValueError(f"unknown linkage method {method!r}")
    d = np.array(distances, dtype="float64")
    n = len(d)
    if d.shape != (n, n):
        raise ValueError("a square distance matrix is needed")
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    alive = np.ones(n, dtype=bool)
    merges: list[tuple[int, int, float]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if method in ("centroid", "median"):
            a, b = divmod(int(np.argmin(d)), n)
        else:
            if not chain:
                chain.append(int(np.argmax(alive)))
            while True:
                a = chain[-1]
                b = int(np.argmin(d[a]))
                if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                    b = chain[-2]
                    del chain[-2:]
                    break
                chain.append(b)
        a, b = min(a, b), max(a, b)
        h = float(d[a, b])
        merges.append((a, b, h))
        row = _updated(method, d[a], d[b], h, size[a], size[b], size)
        row[~alive] = np.inf
        row[[a, b]] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        d[a], d[:, a] = row, row
        size[a] += size[b]
        alive[b] = False
    order = range(n - 1) if method in ("centroid", "median") else np.argsort([m[2] for m in merges], kind="stable")
    node = list(range(n))
    out = np.zeros((max(n - 1, 0), 4))
    parent = list(range(n))
    count = np.ones(2 * n - 1 if n else 0)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, m in enumerate(order):
        a, b, h = merges[m]
        ra, rb = root(a), root(b)
        x, y = sorted((node[ra], node[rb]))
        count[n + k] = count[x] + count[y]
        out[k] = x, y, h, count[n + k]
        parent[rb] = ra
        node[ra] = n + k
    return out


def _flat(z: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Labels 0..k-1, numbered by first row, when merge ``k`` holds wherever ``joined[k]``."""
    n = len(z) + 1
    top = list(range(2 * n - 1))
    for k in reversed(range(n - 1)):
        if joined[k]:
            for child in z[k, :2].astype(int):
                top[child] = top[n + k]
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(top[i], len(seen)) for i in range(n)], dtype="int64")


def subtree_heights(z: np.ndarray) -> np.ndarray:
    """Largest height at or below each merge."""
    n = len(z) + 1
    out = z[:, 2].copy()
    for k in range(n - 1):
        for child in z[k, :2].astype(int):
            if child >= n:
                out[k] = max(out[k], out[child - n])
    return out


def inconsistency(z: np.ndarray, depth: int = 2) -> np.ndarray:
    """How far each merge's height lies above those within ``depth`` levels below it, in standard deviations."""
    n = len(z) + 1
    out = np.zeros(n - 1)
    for k in range(n - 1):
        level, hs = [k], []
        for _ in range(depth):
            hs += [z[j, 2] for j in level]
            level = [int(c) - n for j in level for c in z[j, :2] if c >= n]
        std = np.std(hs, ddof=1) if len(hs) > 1 else 0.0
        out[k] = (z[k, 2] - np.mean(hs)) / std if std > 0 else 0.0
    return out


def cut(z: np.ndarray, threshold: float | None = None, n_clusters: int | None = None, criterion: str = "distance", depth: int = 2, monocrit: np.ndarray | None = None) -> np.ndarray:
    """Flat labels of a linkage by height, inconsistency, a number of clusters or any criterion per merge."""
    n = len(z) + 1
    if n_clusters is not None or criterion == "maxclust":
        k = n_clusters if n_clusters is not None else int(threshold)
        if not 1 <= k <= n:
            raise ValueError("n_clusters must lie between 1 and the number of rows")
        heights = subtree_heights(z)
        for t in threshold_candidates(z):
            joined = heights <= t
            if n - joined.sum() <= k:
                return _flat(z, joined)
        return _flat(z, np.ones(n - 1, dtype=bool))
    if threshold is None:
        return np.zeros(n, dtype="int64")
    if criterion == "distance":
        return _flat(z, subtree_heights(z) <= threshold)
    if criterion in ("inconsistent", "monocrit"):
        values = inconsistency(z, depth) if criterion == "inconsistent" else np.asarray(monocrit, dtype="float64")
        joined = values <= threshold
        for k in range(n - 1):
            joined[k] &= all(joined[int(c) - n] for c in z[k, :2] if c >= n)
        return _flat(z, joined)
    raise ValueError(f"unknown criterion {criterion!r}")


def threshold_candidates(z: np.ndarray) -> np.ndarray:
    """Midpoints of consecutive values of 0, the heights, and the last height again."""
    hs = z[:, 2]
    if not len(hs):
        return np.zeros(0)
    ends = np.r_[0.0, hs, hs[-1]]
    return (ends[:-1] + ends[1:]) / 2


def best_threshold(z: np.ndarray, score: Callable[[np.ndarray], float] | None, fallback: float | None) -> float | None:
    """Candidate with the best score of its labels, the largest one on ties; without a score the fallback, and
    without that the top height (one cluster)."""
    if score is None:
        return fallback if fallback is not None else (float(z[:, 2].max()) if len(z) else 0.0)
    best, at = -np.inf, fallback
    for t in threshold_candidates(z):
        s = score(cut(z, float(t)))
        if s >= best:
            best, at = s, float(t)
    return at


def best_b3_threshold(z: np.ndarray, labels: np.ndarray) -> float | None:
    """:func:`best_threshold` under the B3 F score of the rows labelled (not -1), in one walk over the merges.

    A merge changes the sums of precision and recall by its two clusters only, whose counts of true labels are merged
    smaller into larger: ``n log n`` steps for all candidates together.
    """
    n = len(z) + 1
    heights = subtree_heights(z) if len(z) else np.zeros(0)
    true = labels.tolist()
    size_of: dict = {}
    for t in true:
        if t != -1:
            size_of[t] = size_of.get(t, 0) + 1
    total = sum(size_of.values())
    counts: dict[int, dict] = {i: {true[i]: 1} if true[i] != -1 else {} for i in range(n)}
    members = {i: len(counts[i]) for i in range(n)}
    precision = float(total)
    recall = sum(1 / size_of[t] for t in true if t != -1)
    merged, best, at = 0, -np.inf, None
    # merges take place in the order of the largest height at or below them, as a cut by height does
    order = np.argsort(heights, kind="stable")
    top = dict(zip(range(n), range(n)))
    for t in threshold_candidates(z):
        while merged < n - 1 and heights[order[merged]] <= t:
            k = int(order[merged])
            a, b = (top.pop(int(c)) for c in z[k, :2])
            if len(counts[a]) < len(counts[b]):
                a, b = b, a
            ca, cb = counts[a], counts.pop(b)
            na, nb = members[a], members.pop(b)
            squares = sum(v * v for v in ca.values()), sum(v * v for v in cb.values())
            for key, v in cb.items():
                old = ca.get(key, 0)
                recall += 2 * old * v / size_of[key]
                ca[key] = old + v
            joined = sum(v * v for v in ca.values())
            precision += (joined / (na + nb) if na + nb else 0.0) - (squares[0] / na if na else 0.0) - (squares[1] / nb if nb else 0.0)
            members[a] = na + nb
            top[n + k] = a
            merged += 1
        p, r = precision / total, recall / total
        score = 2 * p * r / (p + r)
        # equal partitions have equal scores, whatever the rounding on the way
        if score >= best - 1e-12:
            best, at = max(best, score), float(t)
    return at


def b3_f_score(true: np.ndarray, pred: np.ndarray) -> float:
    _, t = np.unique(true, return_inverse=True)
    _, p = np.unique(pred, return_inverse=True)
    cell, n = np.unique(np.stack([t, p]), axis=1, return_counts=True)
    nt, np_ = np.bincount(t), np.bincount(p)
    precision, recall = (n**2 / np_[cell[1]]).sum() / len(t), (n**2 / nt[cell[0]]).sum() / len(t)
    return float(2 * precision * recall / (precision + recall))


def silhouette_score(d: np.ndarray, labels: np.ndarray) -> float:
    k = len(np.unique(labels))
    if not 1 < k < len(labels):
        return -1.0
    _, lab = np.unique(labels, return_inverse=True)
    onehot = np.eye(k)[lab]
    sums, counts = d @ onehot, onehot.sum(0)
    own = counts[lab]
    a = np.where(own > 1, sums[np.arange(len(lab)), lab] / np.maximum(own - 1, 1), 0)
    means = sums / counts
    means[np.arange(len(lab)), lab] = np.inf
    b = means.min(1)
    top = np.maximum(a, b)
    return float(np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0).mean())
