"""Dense kernels on one date's assets: components, spanning tree and its order, hierarchical weights, tilt."""

from __future__ import annotations

import numpy as np
import pandas as pd


def components_of(edges: pd.DataFrame) -> pd.DataFrame:
    """Each asset's component, named by its smallest asset."""
    root = {a: a for a in pd.unique(edges[["asset_i", "asset_j"]].to_numpy().ravel())}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in zip(edges["asset_i"], edges["asset_j"]):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return pd.DataFrame({"date": edges["date"].iloc[0], "asset": list(root), "component": [find(a) for a in root]})


def square(cov: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The matrix of a long covariance, assets in order of name."""
    wide = cov.pivot(index="asset_i", columns="asset_j", values="cov").sort_index().sort_index(axis=1)
    return list(wide.index), wide.to_numpy()


def distances(cov: np.ndarray) -> np.ndarray:
    """Correlation distances, between 0 and 1."""
    dev = np.sqrt(np.diag(cov))
    return np.sqrt(np.clip(0.5 * (1 - cov / np.outer(dev, dev)), 0, None))


def tree_of(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Minimum spanning tree by Prim's method: (from, to, distance), in the order in which nodes join."""
    best, parent, left, out = dist[0].copy(), np.zeros(len(dist), int), set(range(1, len(dist))), []
    while left:
        j = min(left, key=lambda k: (best[k], k))
        left.discard(j)
        out.append((int(parent[j]), j, float(best[j])))
        closer = dist[j] < best
        parent[closer], best[closer] = j, dist[j][closer]
    return out


def spanning_tree(cov: pd.DataFrame) -> pd.DataFrame:
    """Minimum spanning tree of correlation distances: date, src, dst, weight."""
    names, c = square(cov)
    return pd.DataFrame([(cov["date"].iloc[0], names[i], names[j], w) for i, j, w in tree_of(distances(c))], columns=["date", "src", "dst", "weight"])


def seriated(cov: np.ndarray, guide: np.ndarray | None = None) -> list[int]:
    """Depth-first order of the spanning tree from the asset of largest variance, or of largest ``guide`` (a centrality); nearer branches first."""
    near: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(cov))}
    for a, b, w in tree_of(distances(cov)):
        near[a].append((w, b))
        near[b].append((w, a))
    start = np.diag(cov) if guide is None or not np.isfinite(guide).any() else np.where(np.isfinite(guide), guide, -np.inf)
    stack, seen = [int(np.argmax(start))], []
    while stack:
        a = stack.pop()
        if a not in seen:
            seen.append(a)
            stack.extend(b for _, b in sorted(near[a], reverse=True) if b not in seen)
    return seen


def bisected(cov: np.ndarray, order: list[int]) -> np.ndarray:
    """Recursive bisection along an order: halves share weight inversely to their equally weighted variance."""
    weight, todo = np.ones(len(cov)), [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        vl, vr = (cov[np.ix_(p, p)].mean() for p in (left, right))
        share = 1 - vl / (vl + vr) if vl + vr > 0 else 0.5
        weight[left] *= share
        weight[right] *= 1 - share
        todo += [left, right]
    return weight / weight.sum()


def hierarchical_weights(cov: pd.DataFrame) -> pd.DataFrame:
    """Weights of one date by recursive bisection along the tree's order: date, asset, weight."""
    names, c = square(cov)
    return pd.DataFrame({"date": cov["date"].iloc[0], "asset": names, "weight": bisected(c, seriated(c))})


def tilted(base: np.ndarray, mu: np.ndarray, cov: np.ndarray, *, max_tilt: float = 0.2, risk_aversion: float = 1.0) -> np.ndarray:
    """Weights moved towards expected excess return per risk, long-only, each by ``max_tilt`` at most; ``base`` where that has no direction."""
    direction = np.clip(np.linalg.pinv(cov) @ (mu - mu.mean()) / risk_aversion, 0, None)
    if not np.isfinite(direction).all() or direction.sum() < 1e-8:
        return base
    move = direction / direction.sum() - base
    size = np.abs(move).max()
    out = np.clip(base + (move * min(1.0, max_tilt / size) if size > 1e-8 else 0), 0, None)
    return out / out.sum()
