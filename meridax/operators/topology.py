"""Topology of return windows: Vietoris-Rips persistence, its summaries, and Mapper graphs.

Diagrams are a long table (date, dim, birth, death); landscapes, entropy, lengths and counts are DataFrame operations on it.
Only what can't be said in columns is a kernel on one window: the reduction of its boundary matrix, the matching of two
diagrams, and the cover, clusters and centralities of one Mapper graph. Windows spread over the cluster.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- persistence of one window


def rips_diagram(points: np.ndarray) -> list[tuple[int, float, float]]:
    """(dim, birth, death) of dimensions 0 and 1 with death after birth, without the one component that never ends.

    Dimension 0: a component dies at the edge that joins it. Dimension 1: edges that close a loop are born; the boundary of
    each triangle, in order of its longest edge, is reduced over bits until its latest edge is one that no other column has.
    """
    n = len(points)
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    edges = sorted((float(dist[i, j]), i, j) for i, j in combinations(range(n), 2))
    number = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    root, out, loops = list(range(n)), [], set()

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (length, i, j) in enumerate(edges):
        a, b = find(i), find(j)
        if a == b:
            loops.add(k)
        else:
            root[max(a, b)] = min(a, b)
            out.append((0, 0.0, length))
    triangles = sorted((max(number[i, j], number[i, k], number[j, k]), number[i, j], number[i, k], number[j, k]) for i, j, k in combinations(range(n), 3))
    columns: dict[int, int] = {}  # by latest edge: a reduced boundary, as bits
    for last, *sides in triangles:
        if len(columns) == len(loops):
            break
        column = sum(1 << e for e in sides)
        while column:
            low = column.bit_length() - 1
            if low not in columns:
                columns[low] = column
                out.append((1, edges[low][0], edges[last][0]))
                break
            column ^= columns[low]
    return [(d, b, e) for d, b, e in out if e > b]


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row the column of a cheapest one-to-one assignment (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        reach, way, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j]:
            done[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < reach[1:])
            reach[1:][better], way[1:][better] = slack[better], j
            free = np.flatnonzero(~done[1:]) + 1
            nxt = int(free[np.argmin(reach[free])])
            step = reach[nxt]
            u[match[done]] += step
            v[done] -= step
            reach[~done] -= step
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def wasserstein(a: np.ndarray, b: np.ndarray, p: float = 2.0) -> float:
    """The p-Wasserstein distance of two diagrams (birth, death), points matched to each other or to the diagonal, by the larger coordinate."""
    n, m = len(a), len(b)
    if n + m == 0:
        return 0.0
    cost = np.zeros((n + m, n + m))
    if n and m:
        cost[:n, :m] = np.abs(a[:, None] - b[None]).max(-1) ** p
    if n:
        cost[:n, m:] = ((a[:, 1] - a[:, 0]) / 2)[:, None] ** p
    if m:
        cost[n:, :m] = ((b[:, 1] - b[:, 0]) / 2)[None] ** p
    return float(cost[np.arange(n + m), assignment(cost)].sum() ** (1 / p))


# ---------------------------------------------------------------- diagrams of all windows


def window_ends(returns: DataFrame, n: int) -> DataFrame:
    """(end, date, asset, ret): the last n dates at each date that has so many; missing returns count 0."""
    dates = returns.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))  # a row per date
    near = dates.select("date", "t", F.explode(F.sequence("t", F.col("t") + (n - 1))).alias("te"))
    ends = dates.where(F.col("t") >= n).select(F.col("date").alias("end"), F.col("t").alias("te"))
    return returns.join(near.join(ends, "te").select("date", "end"), "date").select("end", "date", "asset", F.coalesce(F.nanvl("ret", F.lit(0.0)), F.lit(0.0)).alias("ret"))


def diagrams(returns: DataFrame, n: int = 50) -> DataFrame:
    """(date, dim, birth, death) of the window of n dates that ends at each date; dates are points, assets their coordinates."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        found = rips_diagram(rows.pivot(index="date", columns="asset", values="ret").sort_index().fillna(0.0).to_numpy())
        return pd.DataFrame([(rows["end"].iloc[0], *x) for x in found], columns=["date", "dim", "birth", "death"])

    return window_ends(returns, n).groupBy("end").applyInPandas(kernel, "date date, dim int, birth double, death double")


def summaries(found: DataFrame) -> DataFrame:
    """(date, n_h0, n_h1, total, entropy): counts, sum of lengths, and the entropy of the lengths' shares."""
    lengths = found.withColumn("length", F.col("death") - F.col("birth")).withColumn("share", F.col("length") / F.sum("length").over(Window.partitionBy("date")))
    return lengths.groupBy("date").agg(F.count_if(F.col("dim") == 0).alias("n_h0"), F.count_if(F.col("dim") == 1).alias("n_h1"), F.sum("length").alias("total"), (-F.sum(F.col("share") * F.ln("share"))).alias("entropy"))


def landscapes(found: DataFrame, *, layers: int = 3, bins: int = 100) -> DataFrame:
    """(date, dim, layer, bin, height): the k largest tents over a grid of each dimension from its least birth to its last death."""
    ranges = found.groupBy("dim").agg(F.min("birth").alias("lo"), F.max("death").alias("hi"))  # two rows
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / (bins - 1)
    tents = found.join(F.broadcast(ranges), "dim").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("height", F.least(at - F.col("birth"), F.col("death") - at)).where("height > 0")
    rank = F.row_number().over(Window.partitionBy("date", "dim", "bin").orderBy(F.desc("height")))
    return tents.withColumn("layer", rank).where(F.col("layer") <= layers).select("date", "dim", "layer", "bin", "height")


def turbulence(found: DataFrame, *, norm: str = "l2", layers: int = 3, bins: int = 100) -> DataFrame:
    """(date, turbulence): the norm of each date's landscape."""
    if norm not in ("l1", "l2"):
        raise ValueError("norm must be l1 or l2")
    total = F.sum("height") if norm == "l1" else F.sqrt(F.sum(F.col("height") * F.col("height")))
    heights = landscapes(found, layers=layers, bins=bins).groupBy("date").agg(total.alias("turbulence"))
    return found.select("date").distinct().join(heights, "date", "left").select("date", F.coalesce("turbulence", F.lit(0.0)).alias("turbulence"))


def shifts(found: DataFrame, p: float = 2.0) -> DataFrame:
    """(date, shift): how far each diagram lies from the one before it, over both dimensions; none for the first date."""
    each = found.groupBy("date").agg(F.collect_list(F.struct("dim", "birth", "death")).alias("now"))  # a window's diagram, a few hundred points
    both = each.withColumn("before", F.lag("now").over(Window.orderBy("date"))).where("before is not null")

    def kernel(batches):
        for rows in batches:
            out = []
            for now, before in zip(rows["now"], rows["before"]):
                part = lambda x, d: np.array([(r["birth"], r["death"]) for r in x if r["dim"] == d]).reshape(-1, 2)
                out.append(sum(wasserstein(part(now, d), part(before, d), p) ** p for d in (0, 1)) ** (1 / p))
            yield pd.DataFrame({"date": rows["date"], "shift": out})

    return both.mapInPandas(kernel, "date date, shift double")


# ---------------------------------------------------------------- Mapper of one window


def cover_of(regime: float | None, cubes: int = 10, overlap: float = 0.35) -> tuple[int, float]:
    """More intervals and more overlap as the regime rises."""
    if regime is None or not np.isfinite(regime):
        return cubes, overlap
    r = min(1.0, max(0.0, regime))
    return max(1, round(cubes * (1 + 0.5 * r))), min(0.95, max(0.05, overlap + 0.2 * r))


def lens_values(lens: str, returns: np.ndarray, macro: np.ndarray | None = None) -> np.ndarray:
    """A number for each asset (column): volatility, sharpe, beta to a macro series, or the first principal coordinate (pca)."""
    recent = returns[-252:]
    dev = recent.std(0)
    vol = np.where(dev > 0, dev, np.nan)
    if lens == "sharpe" or (lens != "pca" and not np.isfinite(vol).any()):
        out = np.divide(recent.mean(0) * 252**0.5, vol)
    elif lens == "beta" and macro is not None and np.isfinite(macro).sum() >= 40 and np.nanvar(macro) > 0:
        ok = np.isfinite(macro)
        m = macro[ok] - macro[ok].mean()
        out = (returns[ok] - returns[ok].mean(0)).T @ m / (m @ m)
    elif lens == "pca":
        x = returns.T - returns.T.mean(0)
        left, size, _ = np.linalg.svd(x, full_matrices=False)
        axis = left[:, 0] * size[0]
        return axis if axis[np.abs(axis).argmax()] > 0 else -axis
    elif lens in ("volatility", "beta"):  # a macro series that is short or flat leaves the volatility
        out = vol
    else:
        raise ValueError(f"unknown lens: {lens}")
    return np.nan_to_num(np.where(np.isfinite(out), out, np.nanmean(out) if np.isfinite(out).any() else 0.0))


def epsilon_of(dist: np.ndarray, quantile: float = 0.25, adaptive: bool = True) -> float:
    """The reach of a cluster: a quantile of all distances, a tenth less where their mean lies below it, 0.5 without any."""
    pairs = dist[np.triu_indices(len(dist), 1)]
    pairs = pairs[np.isfinite(pairs)]
    if not len(pairs):
        return 0.5
    eps = float(np.quantile(pairs, quantile))
    return max(1e-6, eps * 0.9 if adaptive and pairs.mean() < eps else eps)


def clusters_of(dist: np.ndarray, eps: float, least: int) -> list[np.ndarray]:
    """Density clusters: points with ``least`` neighbours (themselves included) grow them, others join the first that reaches them or none."""
    near = dist <= eps
    core = near.sum(1) >= least
    label = np.full(len(dist), -1)
    out = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = out
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(near[a] & (label < 0)):
                label[b] = out
                if core[b]:
                    todo.append(b)
        out += 1
    return [np.flatnonzero(label == k) for k in range(out)]


def mapper_graph(lens: np.ndarray, dist: np.ndarray, *, cubes: int = 10, overlap: float = 0.35, eps: float | None = None, least: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Nodes (member arrays) and the adjacency of nodes that share members: overlapping intervals of the lens, clusters within each."""
    eps = epsilon_of(dist) if eps is None else eps
    low, high = float(lens.min()), float(lens.max())
    width = (high - low) / cubes if high > low else 1.0
    margin = width * overlap / 2 / max(1e-9, 1 - overlap)
    nodes = []
    for k in range(cubes):
        held = np.flatnonzero((lens >= low + k * width - margin - 1e-12) & (lens <= low + (k + 1) * width + margin + 1e-12))
        for members in clusters_of(dist[np.ix_(held, held)], eps, least) if len(held) else []:
            if not any(len(held[members]) == len(x) and (held[members] == x).all() for x in nodes):
                nodes.append(held[members])
    sets = [set(x.tolist()) for x in nodes]
    link = np.array([[i != j and bool(a & b) for j, b in enumerate(sets)] for i, a in enumerate(sets)], bool).reshape(len(nodes), len(nodes))
    return nodes, link


def gini(x: np.ndarray) -> float:
    x = np.sort(np.asarray(x, float))
    n = len(x)
    return float(np.clip(2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n, 0, 1)) if n and x.sum() else 0.0


def eigen_centrality(link: np.ndarray) -> np.ndarray:
    """Entries of the leading eigenvector of adjacency plus identity, of unit length; nulls if power iteration doesn't settle."""
    n = len(link)
    x = np.full(n, 1 / max(1, n) ** 0.5)
    step = link + np.eye(n)
    for _ in range(2000):
        y = step @ x
        y = y / np.linalg.norm(y)
        if np.abs(y - x).sum() < n * 1e-6:
            return y
        x = y
    return np.full(n, np.nan)


def between_centrality(link: np.ndarray) -> np.ndarray:
    """The share of shortest paths between other nodes that lead through each, over all pairs (counts of paths by levels)."""
    n, out = len(link), np.zeros(len(link))
    for s in range(n):
        level, paths = np.full(n, -1), np.zeros(n)
        level[s], paths[s], front, order = 0, 1, [s], []
        while front:
            order.append(front)
            nxt = sorted({int(b) for a in front for b in np.flatnonzero(link[a]) if level[b] < 0})
            for b in nxt:
                level[b] = len(order)
                paths[b] = sum(paths[a] for a in front if link[a, b])
            front = nxt
        credit = np.zeros(n)
        for k in range(len(order) - 1, 0, -1):
            for b in order[k]:
                for a in order[k - 1]:
                    if link[a, b]:
                        credit[a] += paths[a] / paths[b] * (1 + credit[b])
                out[b] += credit[b]
    return out / ((n - 1) * (n - 2)) if n > 2 else out * 0


def parts_of(link: np.ndarray) -> int:
    seen, n = np.zeros(len(link), bool), 0
    for s in range(len(link)):
        if not seen[s]:
            n, todo = n + 1, [s]
            seen[s] = True
            while todo:
                near = np.flatnonzero(link[todo.pop()] & ~seen)
                seen[near] = True
                todo.extend(near.tolist())
    return n


NODES = "date date, node int, members array<string>, size int, degree double, eigenvector double, betweenness double, peripherality double, lens_mean double, links array<int>, n_components int, avg_degree double, gini_size double"


def mapper_nodes(returns: DataFrame, n: int, *, lens: str | dict[str, float] = "volatility", cubes: int = 10, overlap: float = 0.35, quantile: float = 0.25, least: int = 2) -> DataFrame:
    """The nodes of each date's Mapper graph over its window, with centralities, links by node number and the graph's totals; ``returns`` may have a regime by date. A custom ``lens`` gives a number for each asset; those it lacks get the mean of the others."""
    rows = window_ends(returns, n)
    if "regime" in returns.columns:
        rows = rows.join(F.broadcast(returns.groupBy(F.col("date").alias("end")).agg(F.first("regime").alias("regime"))), "end")  # a row per date
    else:
        rows = rows.withColumn("regime", F.lit(None).cast("double"))

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="date", columns="asset", values="ret").sort_index().fillna(0.0)
        names, x = list(wide.columns), wide.to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            dist = 1 - np.corrcoef(x, rowvar=False) if len(names) > 1 else np.zeros((1, 1))
        dist = np.where(np.isfinite(dist), dist, 1.0)
        np.fill_diagonal(dist, 0.0)
        k, o = cover_of(frame["regime"].iloc[0], cubes, overlap)
        if isinstance(lens, dict):
            known = np.array([lens.get(a, np.nan) for a in names], float)
            values = np.where(np.isfinite(known), known, np.nanmean(known) if np.isfinite(known).any() else 0.0)
        else:
            values = lens_values(lens, x)
        nodes, link = mapper_graph(values, dist, cubes=k, overlap=o, eps=epsilon_of(dist, quantile), least=least)
        m = len(nodes)
        degree, eigen, through = link.sum(1) / max(1, m - 1), eigen_centrality(link), between_centrality(link)
        totals = (parts_of(link), float(link.sum(1).mean()) if m else 0.0, gini([len(x) for x in nodes]))
        out = [(frame["end"].iloc[0], i, sorted(names[j] for j in own), len(own), float(degree[i]), float(eigen[i]), float(through[i]), 1 - float(degree[i]), float(values[own].mean()), np.flatnonzero(link[i]).tolist(), *totals) for i, own in enumerate(nodes)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    return rows.groupBy("end").applyInPandas(kernel, NODES)


def asset_centrality(nodes: DataFrame) -> DataFrame:
    """(date, asset, centrality): the mean degree centrality of the nodes that hold an asset."""
    return nodes.select("date", F.explode("members").alias("asset"), "degree").groupBy("date", "asset").agg(F.avg("degree").alias("centrality"))


def peripherality(centrality: DataFrame, clip: float = 3.0) -> DataFrame:
    """(date, asset, periphery): the standardised opposite of centrality within each date, clipped; 0 where all are equal."""
    own = Window.partitionBy("date")
    mean, dev = F.avg("centrality").over(own), F.stddev_pop("centrality").over(own)
    z = F.when(dev > 0, (mean - F.col("centrality")) / dev).otherwise(0.0)
    return centrality.select("date", "asset", F.least(F.greatest(z, F.lit(-abs(clip))), F.lit(abs(clip))).alias("periphery"))


def graph_json(nodes: DataFrame) -> DataFrame:
    """(date, graph): each date's graph as one JSON text of nodes and links."""
    node = F.struct(F.col("node").alias("id"), "size", "members", "degree", "lens_mean", "links")
    return nodes.groupBy("date").agg(F.to_json(F.struct(F.sort_array(F.collect_list(node)).alias("nodes"))).alias("graph"))


# ---------------------------------------------------------------- Ledoit-Wolf covariance of one window


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance (divided by n) shrunk to the mean variance, by the share that minimises the expected squared error; and that share."""
    x = x - x.mean(0)
    n, p = x.shape
    cov = x.T @ x / n
    mean = np.trace(cov) / p
    spread = ((cov - mean * np.eye(p)) ** 2).sum() / p
    noise = min(spread, (((x**2).T @ (x**2)).sum() / n - (cov**2).sum()) / n / p)
    share = float(noise / spread) if spread > 0 else 0.0
    return (1 - share) * cov + share * mean * np.eye(p), share


def ledoit_wolf_pairs(returns: DataFrame, n: int) -> DataFrame:
    """(date, asset_i, asset_j, cov, shrinkage) of the window of n dates at each date, of assets with all returns."""
    rows = window_ends(returns.where("ret is not null"), n)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="date", columns="asset", values="ret").sort_index().dropna(axis=1)
        cov, share = ledoit_wolf(wide.to_numpy()) if wide.shape[1] else (np.zeros((0, 0)), 0.0)
        names = np.array(wide.columns)
        i, j = np.indices(cov.shape).reshape(2, -1)
        return pd.DataFrame({"date": frame["end"].iloc[0], "asset_i": names[i], "asset_j": names[j], "cov": cov.ravel(), "shrinkage": share})

    return rows.groupBy("end").applyInPandas(kernel, "date date, asset_i string, asset_j string, cov double, shrinkage double")
