"""The daily fold against cases worked out by hand, and scenarios as groups."""

import datetime
from dataclasses import replace

import numpy as np
import pytest

from meridax.operators import backtest as B
from meridax.operators.portfolio import capped, kpis, window_curves

DAYS = np.array([datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(420)])
NONE = np.full(4, -1)


def prices(seed=3, n=420, m=4, drift=0.0005):
    draw = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(draw.normal(drift, 0.01, (n, m)), 0))


def test_constant_prices_leave_the_book_in_cash():
    days, trades = B.fold(DAYS, np.full((420, 4), 100.0), np.full((420, 4), 1e6), np.zeros(420), NONE, B.Rules())
    assert (days.equity == 1).all() and not days.rebalanced.any() and len(trades) == 0


@pytest.mark.parametrize("method", ["hrp", "hrp_only", "tda_only"])
def test_equity_is_what_weights_earn_less_costs(method):
    price, volume = prices(), np.full((420, 4), 1e4)
    rules = B.Rules(method=method, mdd_limit=-1, vol_multiple=99)
    days, trades = B.fold(DAYS, price, volume, np.full(420, 0.4), NONE, rules)
    # month ends after the first 60 rows, of finished months
    due = [t for t in range(419) if DAYS[t].month != DAYS[t + 1].month and t >= rules.lookback]
    assert [t for t in range(420) if days.rebalanced[t]] == due
    equity, held = 1.0, np.zeros(4)
    for t in range(420):
        if t:
            equity *= 1 + float((price[t] / price[t - 1] - 1) @ held)
        assert days.equity[t] == pytest.approx(equity)
        today = trades[trades.date == DAYS[t]]
        for r in today.itertuples():
            notional = r.fill_qty * r.price
            held[r.asset] += notional / equity
            assert r.fees == pytest.approx(abs(notional) * 5 / 1e4)
            assert r.cash_delta == pytest.approx(-notional - r.fees - r.slip) and 0 <= r.slip <= abs(notional) * 50 / 1e4 + 1e-15
        equity -= float((today.fees + today.slip).sum())
    assert days.gross.iloc[-1] == pytest.approx(np.abs(held).sum())
    assert (days.turnover <= rules.turnover_cap + 1e-9).sum() >= 410


def test_a_fall_empties_the_book_until_it_is_over():
    price = prices(drift=0.0)
    price[200:230] *= np.linspace(1, 0.5, 30)[:, None]
    price[230:] *= 0.5
    rules = B.Rules(mdd_limit=-0.2, mdd_days=40, vol_multiple=99, reset_days=3, turnover_cap=1.0, target_vol=0.5, asset_cap=1, asset_cap_high=1)
    days, _ = B.fold(DAYS, price, np.full((420, 4), 1e9), np.full(420, 0.2), NONE, rules)
    first = int(np.argmax(days.killed))
    assert 200 < first < 230 and days.reason[first].startswith("mdd=-0.") and days.gross[first] == 0
    assert B.drawdown_within(days.equity.to_numpy()[max(0, first - 39) : first + 1]) <= -0.2 < B.drawdown_within(days.equity.to_numpy()[max(0, first - 40) : first])
    again = first + int(np.argmin(days.killed[first:]))
    assert again > first + 3 and not days.killed[again] and days.equity[first + 1 : again + 1].nunique() == 1
    assert B.fold(DAYS, price, np.full((420, 4), 1e9), np.full(420, 2.0), NONE, rules)[0].killed[first:].all()  # an alert that never ends


def test_parts_of_the_fold():
    assert B.kill_reason(np.array([1, 0.7]), np.array([0, -0.3]), B.Rules(vol_multiple=99)) == "mdd=-0.3000"
    assert B.kill_reason(np.array([1, 1.0]), np.array([0.2, -0.2]), B.Rules()).startswith("vol=")
    done = B.fills(np.array([0.5, 0, 0]), np.array([0.2, 0.3, 0.1]), 2.0, np.array([10, 20, np.nan]), np.array([100, np.nan, 1]), B.Rules())
    assert done.asset.tolist() == [0, 1] and done.fill_qty.tolist() == pytest.approx([-0.06, 0.03])
    assert done.slip.tolist() == pytest.approx([0.6 * min(50, 0.1 * 1e4 * 0.6 / 100) / 1e4, 0.6 * 50 / 1e4])
    out = B.caps(np.array([0.7, 0.2, 0.1, 0.0]), 0.4, np.array([0, 1, 1, -1]), 0.25)
    wanted = np.array([0.25, 0.25 * 2 / 3, 0.25 / 3, 0])  # clipped to 0.4, then both clusters scaled to 0.25
    wanted += (1 - wanted.sum()) / 4
    assert out.tolist() == pytest.approx((wanted / wanted.sum()).tolist())
    assert B.turnover_limited(np.array([0.5, 0.5]), np.array([1.0, 0.0]), 0.25).tolist() == [0.75, 0.25]
    assert B.between(0.8, 1.2, 0.5) == 1.0 and B.between(0, 1, 7) == 1.0
    assert B.with_periphery(np.array([0.5, 0.5]), np.array([0.9, 0.1]), 0.5)[1] > 0.5


def test_scenarios_are_groups(spark):
    price = prices()
    rows = [(DAYS[t], f"A{k}", float(price[t, k]), 1e4, 0.4) for t in range(420) for k in range(4)]
    panel = spark.createDataFrame(rows, "date date, asset string, close double, volume double, regime double")
    cheap, dear = B.Rules(scenario="cheap", vol_multiple=99, mdd_limit=-1), B.Rules(scenario="dear", vol_multiple=99, mdd_limit=-1, cost_multiple=3.0)
    got = B.daily(panel, [cheap, dear]).toPandas().sort_values(["scenario", "date"])
    alone, trades = B.fold(DAYS, price, np.full((420, 4), 1e4), np.full(420, 0.4), NONE, replace(cheap))
    assert got[got.scenario == "cheap"].equity.tolist() == pytest.approx(alone.equity.tolist())
    assert B.trades(panel, [cheap]).count() == len(trades)
    table = {r.scenario: r for r in B.summary(B.daily(panel, [cheap, dear])).collect()}
    assert table["dear"].cost > 2 * table["cheap"].cost and table["cheap"].days == 420
    parts = B.summary(B.windows(B.daily(panel, [cheap]), 200, 100), ["scenario", "window_id"]).collect()
    assert sorted((r.window_id, r.days) for r in parts) == [(0, 100), (1, 100)]


def test_a_window_that_starts_under_water_counts_its_own_peak(spark):
    ret = [0.1, -0.5, 0.1, -0.1, 0.2, -1.0, 0.5]
    rows = [(DAYS[i], r, i // 2) for i, r in enumerate(ret)]
    out = window_curves(spark.createDataFrame(rows, "date date, ret double, w int"), ["w"])
    assert {r.w: round(r.mdd, 6) for r in kpis(out, ["w"]).collect()} == {0: -0.5, 1: -0.1, 2: -1.0, 3: 0.0}


def test_caps_on_both_sides_with_clusters(spark):
    rows = [(DAYS[0], a, w, c) for a, w, c in [("a", 0.9, "x"), ("b", -0.6, None), ("c", 0.5, "y"), ("d", 0.2, "y")]]
    got = {r.asset: r.weight for r in capped(spark.createDataFrame(rows, "date date, asset string, weight double, cluster string"), 0.4, 0.3).collect()}
    before = np.array([0.3, -0.4, 0.3 * 4 / 6, 0.3 * 2 / 6])  # a scaled as the only one of its cluster, c and d together
    before[[0, 2, 3]] += (1 - before.sum()) / 3
    assert [got[k] for k in "abcd"] == pytest.approx((before / before.sum()).tolist())
