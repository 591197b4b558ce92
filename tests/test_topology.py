"""Persistence, Mapper and shrinkage kernels against plain code and shapes whose answer is known."""

import datetime
from itertools import combinations, permutations

import numpy as np
import pytest

from meridax.operators import topology as T

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(60)]


def plain_persistence(points):
    """Pairs by reducing the whole boundary matrix of all vertices, edges and triangles, column by column."""
    n = len(points)
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    simplices = sorted(((max([dist[i, j] for i, j in combinations(s, 2)], default=0.0), len(s), s) for k in (1, 2, 3) for s in combinations(range(n), k)))
    number, low, out = {s: k for k, (_, _, s) in enumerate(simplices)}, {}, []
    for k, (at, size, s) in enumerate(simplices):
        column = {number[f] for f in combinations(s, size - 1)} if size > 1 else set()
        while column and max(column) in low:
            column = column ^ low[max(column)]
        if column:
            low[max(column)] = column
            birth = simplices[max(column)][0]
            if at > birth:
                out.append((size - 2, round(birth, 9), round(at, 9)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_diagram_equals_the_whole_reduction(seed):
    points = np.random.default_rng(seed).normal(size=(13, 2 + seed % 2))
    assert sorted((d, round(b, 9), round(e, 9)) for d, b, e in T.rips_diagram(points)) == plain_persistence(points)


def test_a_circle_has_one_long_loop():
    at = np.linspace(0, 2 * np.pi, 16, endpoint=False)
    loops = sorted((e - b for d, b, e in T.rips_diagram(np.c_[np.cos(at), np.sin(at)]) if d == 1), reverse=True)
    assert loops[0] > 1 and sum(x > 0.1 for x in loops) == 1


def test_assignment_and_wasserstein():
    draw = np.random.default_rng(5)
    for n in (1, 3, 6):
        cost = draw.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert cost[np.arange(n), T.assignment(cost)].sum() == pytest.approx(best)
    a = np.array([[0.0, 1.0], [0.0, 0.2]])
    assert T.wasserstein(a, a) == 0 and T.wasserstein(a, a[:1]) == pytest.approx(0.1) and T.wasserstein(a[:0], a[:0]) == 0
    assert T.wasserstein(np.array([[0, 1.0]]), np.array([[0, 1.5]])) == pytest.approx(0.5)


def test_landscapes_and_summaries(spark):
    rows = [(DAYS[0], 0, 0.0, 1.0), (DAYS[0], 0, 0.0, 0.5), (DAYS[0], 1, 0.5, 1.5), (DAYS[1], 0, 0.0, 1.0)]
    found = spark.createDataFrame(rows, "date date, dim int, birth double, death double")
    grid = {0: np.linspace(0, 1, 11), 1: np.linspace(0.5, 1.5, 11)}
    heights = {0: np.sort([np.clip(np.minimum(grid[0] - b, d - grid[0]), 0, None) for b, d in ((0, 1), (0, 0.5))], 0)[::-1], 1: [np.clip(np.minimum(grid[1] - 0.5, 1.5 - grid[1]), 0, None)]}
    got = {r.date: r.turbulence for r in T.turbulence(found, layers=3, bins=11).collect()}
    assert got[DAYS[0]] == pytest.approx(np.sqrt(sum((np.array(h) ** 2).sum() for h in heights.values())))
    assert {r.date: r.turbulence for r in T.turbulence(found, layers=1, norm="l1", bins=11).collect()}[DAYS[0]] == pytest.approx(heights[0][0].sum() + heights[1][0].sum())
    with pytest.raises(ValueError):
        T.turbulence(found, norm="l3")
    s = {r.date: r for r in T.summaries(found).collect()}[DAYS[0]]
    p = np.array([1, 0.5, 1]) / 2.5
    assert (s.n_h0, s.n_h1, s.total) == (2, 1, 2.5) and s.entropy == pytest.approx(-(p * np.log(p)).sum())
    assert [(r.date, pytest.approx(r["shift"])) for r in T.shifts(found).collect()] == [(DAYS[1], np.sqrt(0.25**2 + 0.5**2))]


def test_windows_of_returns(spark):
    draw = np.random.default_rng(42)
    x = draw.normal(0, 0.01, (30, 3))
    rows = [(DAYS[t], f"T{k}", float(x[t, k])) for t in range(30) for k in range(3)]
    returns = spark.createDataFrame(rows, "date date, asset string, ret double")
    got = T.diagrams(returns, 10).toPandas()
    assert sorted(got.date.unique()) == DAYS[9:30]
    own = got[got.date == DAYS[20]]
    assert sorted(zip(own.dim, own.birth.round(9), own.death.round(9))) == plain_persistence(x[11:21])
    lw = T.ledoit_wolf_pairs(returns, 30).toPandas()
    y = x - x.mean(0)
    s = y.T @ y / 30
    mu = np.trace(s) / 3
    d2 = ((s - mu * np.eye(3)) ** 2).sum() / 3
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() / 3 for r in y) / 30**2)
    wanted = b2 / d2 * mu * np.eye(3) + (1 - b2 / d2) * s
    assert np.allclose(lw.pivot(index="asset_i", columns="asset_j", values="cov").to_numpy(), wanted) and lw.shrinkage.iloc[0] == pytest.approx(b2 / d2)


def test_path_graph_metrics():
    link = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], bool)
    assert T.parts_of(link) == 1 and link.sum(1).mean() == pytest.approx(4 / 3) and T.gini([2, 2, 2]) == 0
    assert T.between_centrality(link).tolist() == [0, 1, 0]
    assert T.eigen_centrality(link) == pytest.approx([0.5, 2**0.5 / 2, 0.5], abs=1e-4)
    assert T.parts_of(np.zeros((3, 3), bool)) == 3 and T.gini([1, 1, 8]) == pytest.approx(2 * (1 + 2 + 24) / 30 - 4 / 3)
    draw = np.random.default_rng(2)
    link = draw.random((8, 8)) < 0.3
    link = (link | link.T) & ~np.eye(8, dtype=bool)
    reach = np.where(link, 1.0, np.inf)
    np.fill_diagonal(reach, 0)
    for k in range(8):
        reach = np.minimum(reach, reach[:, k : k + 1] + reach[k])
    ways = np.eye(8)
    for step in range(1, 8):
        for i in range(8):
            for j in range(8):
                if reach[i, j] == step:
                    ways[i, j] = sum(ways[i, k] for k in range(8) if link[k, j] and reach[i, k] == step - 1)
    wanted = [sum(ways[i, k] * ways[k, j] / ways[i, j] for i in range(8) for j in range(8) if i != j and k not in (i, j) and np.isfinite(reach[i, j]) and reach[i, k] + reach[k, j] == reach[i, j]) / 42 for k in range(8)]
    assert T.between_centrality(link).tolist() == pytest.approx(wanted)


def test_mapper(spark):
    lens = np.array([0, 0.1, 0.5, 0.55, 1.0, 0.9])
    dist = np.abs(lens[:, None] - lens[None])
    nodes, link = T.mapper_graph(lens, dist, cubes=2, overlap=0.5, eps=0.2, least=2)
    assert {tuple(x.tolist()) for x in nodes} == {(0, 1), (2, 3), (4, 5)} and not link.any()
    nodes, link = T.mapper_graph(lens, dist, cubes=2, overlap=0.5, eps=0.5, least=1)
    assert link[0, 1] and len(nodes) == 2
    assert T.cover_of(1.0) == (15, pytest.approx(0.55)) and T.cover_of(None) == (10, 0.35)
    assert T.epsilon_of(np.zeros((1, 1))) == 0.5
    x = np.random.default_rng(7).normal(0, 0.01, (60, 4))
    macro = x[:, 0] * 2 + 1
    assert T.lens_values("beta", x, macro)[0] == pytest.approx(0.5) and (T.lens_values("beta", x, None) == x.std(0)).all()
    with pytest.raises(ValueError):
        T.lens_values("other", x)
    rows = [(DAYS[t], f"A{k}", float(x[t, k]), 0.5) for t in range(60) for k in range(4)]
    nodes = T.mapper_nodes(spark.createDataFrame(rows, "date date, asset string, ret double, regime double"), 58, cubes=3, least=1)
    out = nodes.toPandas()
    assert sorted(out.date.unique()) == DAYS[57:60] and (out["size"] == out.members.map(len)).all() and (out.peripherality == 1 - out.degree).all()
    assert T.graph_json(nodes).count() == 3
    own = T.mapper_nodes(spark.createDataFrame(rows, "date date, asset string, ret double, regime double"), 60, lens={"A0": 0.0, "A1": 0.0, "A2": 4.0}, cubes=2, overlap=0.1, least=1).collect()
    low, high = ({m for r in own if (r.lens_mean < 1) == side for m in r.members} for side in (True, False))
    assert low == {"A0", "A1", "A3"} - high | (low & {"A3"}) and "A2" in high and not {"A0", "A1"} & high


def test_peripherality(spark):
    rows = [(DAYS[0], "A", 0.9), (DAYS[0], "B", 0.2), (DAYS[0], "C", 0.5), (DAYS[1], "A", 0.4), (DAYS[1], "B", 0.4)]
    got = {(r.date, r.asset): r.periphery for r in T.peripherality(spark.createDataFrame(rows, "date date, asset string, centrality double")).collect()}
    z = -(np.array([0.9, 0.2, 0.5]) - np.mean([0.9, 0.2, 0.5])) / np.std([0.9, 0.2, 0.5])
    assert [got[DAYS[0], k] for k in "ABC"] == pytest.approx(z.tolist()) and got[DAYS[1], "A"] == 0
