"""The walk-forward blend learns a known mix and never sees the future."""

import datetime

import numpy as np
import pytest

from meridax.operators import blend as B

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(40)]


def rows(draw):
    out = []
    for t in range(40):
        for a in range(8):
            f, g = draw.normal(size=2)
            out.append((DAYS[t], f"A{a}", float(f), float(g), float(0.7 * f + 0.3 * g + draw.normal(0, 0.05))))
    return out


def test_ridge_and_elastic_net():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 3)) * [1, 5, 0.1] + [0, 2, 0]
    y = x @ [0.5, 0.0, 4.0] + 1 + draw.normal(0, 0.01, 60)
    z = (x - x.mean(0)) / x.std(0)
    assert B.Ridge(2.0).fit(x, y).weights == pytest.approx(np.linalg.inv(z.T @ z + 2 * np.eye(3)) @ z.T @ (y - y.mean()))
    assert B.Ridge(1e-9, 1e-9).fit(x, y).predict(x) == pytest.approx(B.Ridge(1e-9).fit(x, y).predict(x), abs=1e-6)
    sparse = B.Ridge(5.0, 1.0).fit(x, y).weights
    assert sparse[1] == 0 and sparse[0] > 0 and sparse[2] > 0
    net = B.Ridge(3.0, 0.4).fit(x, y)
    slope = z.T @ (y - y.mean() - z @ net.weights) - 3 * 0.6 * net.weights
    on = net.weights != 0
    assert slope[on] == pytest.approx((np.sign(net.weights) * 1.2)[on], abs=1e-6) and (np.abs(slope[~on]) <= 1.2 + 1e-6).all()
    assert B.Ridge().set_params(penalty=4.0).get_params()["penalty"] == 4.0
    with pytest.raises(ValueError):
        B.Ridge().set_params(other=1)


def test_purged_folds():
    groups = np.repeat(np.arange(20), 3)
    parts = B.purged(groups, 4, 2)
    assert len(parts) == 4 and (sum(test for _, test in parts) == 1).all()
    for train, test in parts:
        gap = np.abs(groups[train][:, None] - groups[test][None]).min()
        assert gap == 3


def test_metrics():
    dates, y = np.repeat([1, 2], 3), np.array([1.0, 2, 3, 1, 2, 3])
    assert B.mean_ic(dates, np.array([1.0, 2, 3, 3, 2, 1]), y) == pytest.approx(0)
    assert np.isnan(B.mean_ic(dates, np.ones(6), y)) and B.mean_ic(dates[:4], np.array([1.0, 2, 3, 9]), y[:4]) == 1
    earned = [((np.array([-1.0, 0, 1]) / 2) @ y[:3]), ((np.array([1.0, 0, -1]) / 2) @ y[3:])]
    assert B.long_short_sharpe(dates, np.array([1.0, 2, 3, 3, 2, 1]), y) == pytest.approx(np.mean(earned) / np.std(earned))


def test_walk_learns_from_known_targets_only(spark):
    data = rows(np.random.default_rng(7))
    frame = spark.createDataFrame(data, "date date, asset string, f double, g double, target double")
    got = B.walk(frame, ["f", "g"], train=20, horizon=2, grid=[{"penalty": 0.1}, {"penalty": 1e6}]).toPandas()
    assert sorted(got.date.unique()) == DAYS[4:]  # three known dates at least
    late = got[got.date == DAYS[30]].sort_values("asset")
    past = [r for r in data if DAYS[30 - 21] <= r[0] <= DAYS[28]]
    x, y = np.array([r[2:4] for r in past]), np.array([r[4] for r in past])
    own = np.array([r[2:4] for r in data if r[0] == DAYS[30]])
    assert late.score.tolist() == pytest.approx(B.Ridge(0.1).fit(x, y).predict(own).tolist()) and (late.train_rows == 160).all() and (late.penalty == 0.1).all()
    targets = {(r[0], r[1]): r[4] for r in data}
    ic = [np.corrcoef(part.score, [targets[d, a] for a in part.asset])[0, 1] for d, part in got.groupby("date")]
    assert np.mean(ic) > 0.9
    # what lies ahead changes nothing
    changed = [(d, a, f, g, t if d <= DAYS[28] else 99.0) for d, a, f, g, t in data]
    again = B.walk(spark.createDataFrame(changed, frame.schema), ["f", "g"], train=20, horizon=2, grid=[{"penalty": 0.1}, {"penalty": 1e6}]).toPandas()
    assert again[again.date == DAYS[30]].sort_values("asset").score.tolist() == late.score.tolist()
    with pytest.raises(ValueError):
        B.walk(frame, ["f"], metric="other")
