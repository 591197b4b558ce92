"""A blend of factors learned walk-forward: purged folds choose the penalty, a ridge on standardised features scores the next date.

Training rows of a date are those whose forward return is known by then. Dates spread over the cluster; one date's training
rows are a bounded window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interactions(frame: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``a_x_b``, the product of two columns, for each pair."""
    return frame.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def purged(groups: np.ndarray, folds: int, gap: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, test) masks: contiguous test folds of the distinct ordered groups (dates), training without ``gap`` groups on both sides."""
    order, spot = np.unique(groups, return_inverse=True)
    out = []
    for part in np.array_split(np.arange(len(order)), min(folds, len(order))):
        test = (spot >= part[0]) & (spot <= part[-1])
        train = (spot < part[0] - gap) | (spot > part[-1] + gap)
        if test.any() and train.any():
            out.append((train, test))
    return out


class Ridge:
    """Least squares on standardised features with a squared penalty, or an elastic net of both penalties by coordinate descent (``mixing`` above 0)."""

    def __init__(self, penalty: float = 1.0, mixing: float = 0.0, rounds: int = 200):
        self.penalty, self.mixing, self.rounds = penalty, mixing, rounds

    def get_params(self) -> dict:
        return {"penalty": self.penalty, "mixing": self.mixing, "rounds": self.rounds}

    def set_params(self, **params) -> Ridge:
        for k, v in params.items():
            if k not in self.get_params():
                raise ValueError(f"unknown parameter: {k}")
            setattr(self, k, v)
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z, self.base = (x - self.mean) / self.scale, y.mean()
        n, p = z.shape
        gram, hit = z.T @ z, z.T @ (y - self.base)
        if self.mixing == 0:
            self.weights = np.linalg.solve(gram + self.penalty * np.eye(p), hit)
            return self
        self.weights = np.zeros(p)
        flat, round_ = self.penalty * self.mixing, self.penalty * (1 - self.mixing)
        for _ in range(self.rounds):
            before = self.weights.copy()
            for j in range(p):
                rest = hit[j] - gram[j] @ self.weights + gram[j, j] * self.weights[j]
                self.weights[j] = np.sign(rest) * max(0.0, abs(rest) - flat) / (gram[j, j] + round_)
            if np.abs(self.weights - before).max() < 1e-10:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.base


def mean_ic(dates: np.ndarray, scores: np.ndarray, y: np.ndarray, least: int = 3) -> float:
    """The mean over dates of the correlation of scores and outcomes; dates with few assets or no spread don't count."""
    found = []
    for d in np.unique(dates):
        own = dates == d
        if own.sum() >= least and scores[own].std() > 0 and y[own].std() > 0:
            found.append(np.corrcoef(scores[own], y[own])[0, 1])
    return float(np.mean(found)) if found else float("nan")


def long_short_sharpe(dates: np.ndarray, scores: np.ndarray, y: np.ndarray) -> float:
    """The Sharpe ratio, by date, of a book weighted by standardised scores."""
    earned = []
    for d in np.unique(dates):
        own = dates == d
        z = scores[own] - scores[own].mean()
        if np.abs(z).sum() > 0:
            earned.append(float(z @ y[own] / np.abs(z).sum()))
    spread = np.std(earned) if earned else 0.0
    return float(np.mean(earned) / spread) if spread > 0 else float("nan")


METRICS = {"ic": mean_ic, "sharpe": long_short_sharpe}


def chosen(x: np.ndarray, y: np.ndarray, dates: np.ndarray, grid: Sequence[dict], folds: int, gap: int, metric: str) -> tuple[dict, float]:
    """The parameters of the best mean metric over purged folds, the first of equal ones, and that metric."""
    best, top = dict(grid[0]), float("nan")
    for params in grid:
        found = [METRICS[metric](dates[test], Ridge(**params).fit(x[train], y[train]).predict(x[test]), y[test]) for train, test in purged(dates, folds, gap)]
        found = [v for v in found if np.isfinite(v)]
        if found and not np.mean(found) <= top:
            best, top = dict(params), float(np.mean(found))
    return best, top


def walk(rows: DataFrame, features: Sequence[str], *, train: int = 24, horizon: int = 1, folds: int = 4, grid: Sequence[dict] = ({"penalty": 1.0}, {"penalty": 10.0}), metric: str = "ic") -> DataFrame:
    """(date, asset, score, penalty, cv_metric, train_rows) from (date, asset, features, target): each date's model learns from
    the ``train`` dates before it whose target, ``horizon`` dates ahead, is known by then. Dates with fewer than three of them have no score."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    dates = rows.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))  # a row per date
    numbered = rows.join(F.broadcast(dates), "date")
    # a row serves its own date and the dates whose training window holds it
    last = dates.agg(F.max("t").alias("most"))  # one row
    served = numbered.crossJoin(F.broadcast(last)).withColumn("at", F.explode(F.expr(f"array_union(array(t), case when t + {horizon} <= most then sequence(t + {horizon}, least(most, t + {horizon + train - 1})) else array() end)")))
    names = list(features)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["at"].iloc[0]
        own = frame[frame["t"] == at].dropna(subset=names)
        past = frame[frame["t"] < at].dropna(subset=[*names, "target"])
        empty = pd.DataFrame(columns=["date", "asset", "score", "penalty", "cv_metric", "train_rows"])
        if past["t"].nunique() < 3 or own.empty:
            return empty
        x, y, t = past[names].to_numpy(float), past["target"].to_numpy(float), past["t"].to_numpy()
        params, value = chosen(x, y, t, grid, folds, horizon, metric)
        score = Ridge(**params).fit(x, y).predict(own[names].to_numpy(float))
        return pd.DataFrame({"date": own["date"], "asset": own["asset"], "score": score, "penalty": params.get("penalty", 1.0), "cv_metric": value, "train_rows": len(past)})

    return served.groupBy("at").applyInPandas(kernel, "date date, asset string, score double, penalty double, cv_metric double, train_rows long")
