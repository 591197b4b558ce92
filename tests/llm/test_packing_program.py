"""The configuration program: its cover, its bound, and the share of sequences that its patterns make."""

import random
import warnings

import numpy as np
import pytest

from meridax.llm import packing


def lengths(n, seed=2):
    draw = random.Random(seed)
    out = {}
    for _ in range(n):
        size = min(30_000, int(draw.lognormvariate(5.8, 1.3)) + 1)
        for a in range(0, size, 4096):
            k = min(4096, size - a)
            out[k] = out.get(k, 0) + 1
    return out


def test_cover_is_whole_and_near_its_bound():
    histogram = lengths(5000)
    pools = packing.size_classes(dict(histogram), 4096)
    size, demand = np.array([c[0][0] for c in pools]), np.array([sum(n for _, n in c) for c in pools])
    patterns, amounts, bound = packing.configuration_program(size, demand, 4096)
    assert (patterns @ size <= 4096).all() and (amounts >= 0).all()
    assert (patterns.T @ amounts >= demand * (1 - 1e-6)).all()
    assert bound <= amounts.sum() <= 1.01 * bound
    plan = packing.Plan(dict(histogram), 4096)
    whole = sum(k * n for k, n in histogram.items()) / 4096
    assert plan.sequences <= 1.01 * whole + 1
    assert plan.by_patterns >= 0.85 * plan.sequences


@pytest.mark.parametrize("histogram, best", [({2048: 4, 4096: 3, 1: 7}, 6), ({2049: 10}, 10), ({1400: 6, 1296: 3}, 3), ({7: 3}, 1), ({}, 0), ({4096: 5}, 5)], ids=str)
def test_small_histograms_take_the_fewest_sequences(histogram, best):
    assert packing.Plan(dict(histogram), 4096).sequences == best


def test_pieces_about_half_the_capacity_need_the_game():
    draw = random.Random(4)
    histogram = {k: draw.randrange(1, 9) for k in range(2050, 2300, 3)}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        plan = packing.Plan(dict(histogram), 4096)
    assert plan.sequences == sum(histogram.values())
    assert plan.bound <= plan.cover + 1e-6 and plan.bound >= 0.9 * plan.cover


def test_places_of_a_plan():
    histogram = lengths(700, 9)
    rows = packing.Plan(dict(histogram), 4096).table()
    taken, places = {}, {}
    for length, first, last, times, sequence, offset in rows.tolist():
        taken.setdefault(length, []).append((first, last))
        for k in range(last - first):
            places.setdefault(sequence + k // times, []).append((offset + k % times * length, length))
    for length, n in histogram.items():
        edges = sorted(taken[length])
        assert edges[0][0] == 0 and edges[-1][1] == n and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    for own in places.values():
        own.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 4096
