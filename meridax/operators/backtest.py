"""The daily fold of a portfolio: a loop over dates for one scenario, and scenarios side by side as groups of a Spark job.

A scenario is a row of rules. Its panel is an array problem of dates x assets, which one task holds; scenarios, not dates,
are what spreads over the cluster. The fold's state is equity, weights, and the kill switch; each date gives a row.

Missing prices are carried forward, missing returns count 0. Dates of the schedule without candidates keep the weights.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridax.operators.graphs import bisected, seriated, tilted

DAYS = 252.0


@dataclass(frozen=True)
class Rules:
    """One scenario. Pairs (low, high) are met at regime 0 and 1, linearly between; equal ends switch that off."""

    scenario: str = "base"
    method: str = "hrp"  # hrp: tree weights times the mix; hrp_only: tree weights; tda_only: equal weights times the mix
    schedule: int = 0  # rows from one rebalance to the next; 0: the last row of each finished month
    lookback: int = 60  # rows of the covariance
    range_days: int = 14  # rows of the average absolute return
    adv_days: int = 20
    momentum_days: int = 63
    temperature: float = 0.7
    tilt: float = 0.0  # most that an expected return may move a weight; 0: the mix by softmax instead
    tilt_regime: float = 0.0  # tilt only at this regime or above
    risk_aversion: float = 1.0
    target_vol: float = 0.12
    vol_low: float = 0.8
    vol_high: float = 1.2
    gross_low: float = 1.0
    gross_high: float = 1.0
    asset_cap: float = 0.10
    asset_cap_high: float = 0.10
    cluster_cap: float = 1.0
    turnover_cap: float = 0.25
    fee_bps: float = 5.0
    impact: float = 0.1
    impact_bps: float = 50.0
    mdd_days: int = 90
    mdd_limit: float = -0.20
    vol_multiple: float = 1.8
    reset_days: int = 5  # so many rows below the alert, and no reason left, end a stop
    alert: float = 1.0
    cost_multiple: float = 1.0
    periphery: float = 0.0


def between(low: float, high: float, at: float) -> float:
    return low + (high - low) * min(1.0, max(0.0, at))


def drawdown_within(equity: np.ndarray) -> float:
    """The deepest fall from a peak inside these values."""
    equity = equity[np.isfinite(equity)]
    return float((equity / np.maximum.accumulate(equity) - 1).min()) if len(equity) > 1 else 0.0


def kill_reason(equity: np.ndarray, returns: np.ndarray, rules: Rules) -> str:
    """Why trading must stop, by the last ``mdd_days`` rows: the fall, the volatility, both, or an empty text."""
    fall = drawdown_within(equity[-rules.mdd_days :])
    recent = returns[-rules.mdd_days :]
    swing = float(np.std(recent)) * DAYS**0.5 if len(recent) > 1 else 0.0
    reasons = [f"mdd={fall:.4f}"] * (fall <= rules.mdd_limit) + [f"vol={swing:.4f}"] * (swing > rules.vol_multiple * rules.target_vol)
    return ",".join(reasons)


def calm(regime: np.ndarray, since: int, rules: Rules) -> bool:
    """Whether the last ``reset_days`` values after row ``since`` all lie below the alert; true if there are none yet."""
    recent = regime[since + 1 :][-rules.reset_days :]
    return not len(recent) or int((recent < rules.alert).sum()) >= rules.reset_days


def fills(prev: np.ndarray, new: np.ndarray, equity: float, price: np.ndarray, adv: np.ndarray, rules: Rules) -> pd.DataFrame:
    """Trades from old to new weights: asset number, quantity, cash, commission and slippage. Without a known volume ten times the new position is assumed."""
    traded = np.flatnonzero((np.abs(new - prev) >= 1e-9) & np.isfinite(price) & (price > 0))
    notional = (new - prev)[traded] * equity
    known = np.where(np.isfinite(adv[traded]) & (adv[traded] > 0), adv[traded], np.abs(new[traded] * equity) * 10)
    size = np.abs(notional)
    share = np.divide(size, known, out=np.full(len(size), np.inf), where=known > 0)
    fees = size * rules.fee_bps * rules.cost_multiple / 1e4
    slip = size * np.minimum(rules.impact_bps, rules.impact * 1e4 * share) * rules.cost_multiple / 1e4
    return pd.DataFrame({"asset": traded, "price": price[traded], "fill_qty": notional / price[traded], "cash_delta": -notional - fees - slip, "fees": fees, "slip": slip})


def caps(weight: np.ndarray, cap: float, cluster: np.ndarray, cluster_cap: float) -> np.ndarray:
    """Clip, scale heavy clusters, spread the rest over assets below the cap, scale to 1."""
    out = np.clip(weight, -cap, cap)
    for c in np.unique(cluster[cluster >= 0]):
        own = cluster == c
        held = abs(out[own].sum())
        if held > cluster_cap:
            out[own] *= cluster_cap / held
    free = np.abs(out) < cap
    if free.any():
        out[free] += (1 - out.sum()) / free.sum()
    return out / out.sum()


def turnover_limited(prev: np.ndarray, new: np.ndarray, cap: float) -> np.ndarray:
    turn = np.abs(new - prev).sum() / 2
    if turn <= cap:
        return new
    moved = prev + (new - prev) * cap / turn
    return moved / moved.sum()


def softmax(x: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((x - x.max()) / max(temperature, 1e-6))
    return e / e.sum()


def with_periphery(weight: np.ndarray, centrality: np.ndarray | None, strength: float) -> np.ndarray:
    """Weights leaning to assets that are less central than the others: times exp(-strength * standardised centrality)."""
    if centrality is None or strength <= 0 or not np.isfinite(centrality).any():
        return weight
    z = np.where(np.isfinite(centrality), centrality, np.nanmean(centrality))
    z = (z - z.mean()) / z.std() if z.std() > 0 else z * 0
    out = weight * np.exp(-strength * z)
    return out / out.sum()


def target(rules: Rules, returns: np.ndarray, ranges: np.ndarray, regime: float, cluster: np.ndarray, centrality: np.ndarray | None = None) -> tuple[np.ndarray | None, dict]:
    """Target weights over all assets from the returns up to a date, and whether caps bound. None without two assets of known covariance."""
    recent = returns[-rules.lookback :]
    usable = np.flatnonzero(np.isfinite(recent).all(0) & (np.nanstd(recent, axis=0) > 0)) if len(recent) >= rules.lookback else np.zeros(0, int)
    if len(usable) < 2:
        return None, {}
    cov = np.cov(recent[:, usable], rowvar=False)
    base = np.full(len(usable), 1 / len(usable)) if rules.method == "tda_only" else bisected(cov, seriated(cov))
    base = with_periphery(base, None if centrality is None else centrality[usable], rules.periphery)
    signal = np.nan_to_num(returns[-rules.momentum_days :][:, usable]).mean(0)
    spread = signal.std()
    z = (signal - signal.mean()) / spread if spread > 1e-12 else np.zeros(len(usable))
    if rules.method == "hrp_only":
        weight = base
    elif rules.tilt > 0 and regime >= rules.tilt_regime:
        weight = tilted(base, z, cov, max_tilt=rules.tilt, risk_aversion=rules.risk_aversion)
    else:
        weight = base * softmax(z, rules.temperature)
        weight = weight / weight.sum()
    cap = between(rules.asset_cap, rules.asset_cap_high, regime)
    before, groups = weight, cluster[usable]
    weight = caps(weight, cap, groups, max(rules.cluster_cap, cap))
    inverse = np.where(ranges[usable] > 0, 1 / np.where(ranges[usable] > 0, ranges[usable], 1), 0.0)
    if not np.abs(weight * inverse).sum() > 0:
        return None, {}
    weight = weight * inverse / np.abs(weight * inverse).sum()
    risk = float(weight @ cov @ weight) * DAYS
    if not risk > 0:
        return None, {}
    vol = max(1e-6, rules.target_vol * between(rules.vol_low, rules.vol_high, regime))
    out = np.zeros(returns.shape[1])
    out[usable] = weight * vol / risk**0.5 * between(rules.gross_low, rules.gross_high, regime)
    return out, {"asset_hits": int((np.abs(before) > cap + 1e-12).sum()), "cap_bound": bool(np.abs(caps(before, cap, groups, max(rules.cluster_cap, cap)) - before).max() > 1e-9)}


def scheduled(dates: np.ndarray, rules: Rules) -> np.ndarray:
    """Which rows rebalance."""
    if rules.schedule:
        return np.arange(len(dates)) % rules.schedule == 0
    month = np.asarray(pd.to_datetime(dates).to_period("M").astype("int64"))
    return np.append(month[1:] != month[:-1], False)


def fold(dates: np.ndarray, price: np.ndarray, volume: np.ndarray, regime: np.ndarray, cluster: np.ndarray, rules: Rules, centrality: np.ndarray | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A row per date (ret, equity, gross, turnover, cost, killed, reason, rebalanced, cap_bound, asset_hits), and the trades.

    A date first earns yesterday's weights; then the kill switch may empty the book; else a scheduled date rebalances.
    """
    price = pd.DataFrame(price).ffill().to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        returns = np.vstack([np.full((1, price.shape[1]), np.nan), price[1:] / price[:-1] - 1])
    returns[~np.isfinite(returns)] = np.nan
    known = np.nan_to_num(returns)
    ranges = pd.DataFrame(np.abs(returns)).rolling(rules.range_days).mean().to_numpy()
    adv = (pd.DataFrame(volume).rolling(rules.adv_days).mean() * pd.DataFrame(price)).to_numpy()
    n, m = price.shape
    weight, equity, killed, since, due = np.zeros(m), 1.0, False, -1, scheduled(dates, rules)
    curve, earned, rows, trades = np.full(n, np.nan), np.zeros(n), [], []
    for t in range(n):
        earned[t] = float(known[t] @ weight)
        equity *= 1 + earned[t]
        curve[t] = equity
        reason = kill_reason(curve[: t + 1], earned[: t + 1], rules)
        now = between(0.0, 1.0, regime[t]) if np.isfinite(regime[t]) else 0.0
        row = {"turnover": 0.0, "cost": 0.0, "rebalanced": False, "cap_bound": False, "asset_hits": 0}
        goal = None
        if reason and not killed:
            killed, since, goal = True, t, np.zeros(m)
        elif killed:
            killed = bool(reason) or not calm(regime[: t + 1], since, rules)
        elif due[t]:
            goal, about = target(rules, returns[: t + 1], ranges[t], now, cluster, None if centrality is None else centrality[t])
            if goal is not None:
                row |= about | {"rebalanced": True}
                gross = np.abs(goal).sum()
                if np.abs(goal - weight).sum() / 2 > rules.turnover_cap and gross > 0:
                    goal = turnover_limited(weight, goal, rules.turnover_cap)
        if goal is not None:
            done = fills(weight, goal, equity, price[t], adv[t], rules)
            cost = float((done["fees"] + done["slip"]).sum())
            row |= {"turnover": float(np.abs(goal - weight).sum() / 2), "cost": cost}
            equity -= cost
            weight = goal
            trades.append(done.assign(date=dates[t]))
        rows.append({"date": dates[t], "ret": earned[t], "equity": curve[t], "gross": float(np.abs(weight).sum()), "killed": killed, "reason": reason or "ok", **row})
    return pd.DataFrame(rows), pd.concat(trades) if trades else pd.DataFrame(columns=["asset", "price", "fill_qty", "cash_delta", "fees", "slip", "date"])


_DAY = "scenario string, date date, ret double, equity double, gross double, turnover double, cost double, killed boolean, reason string, rebalanced boolean, cap_bound boolean, asset_hits int"
_TRADE = "scenario string, date date, asset string, price double, fill_qty double, cash_delta double, fees double, slip double"


def _arrays(rows: pd.DataFrame):
    wide = rows.pivot(index="date", columns="asset", values=["close", "volume"]).sort_index()
    names = list(wide["close"].columns)
    regime = rows.groupby("date")["regime"].first().sort_index().to_numpy(float)
    groups = rows.groupby("asset")["cluster"].first().reindex(names)
    cluster = np.array([-1 if c is None or c != c else int(c) for c in groups])
    return wide.index.to_numpy(), names, wide["close"].to_numpy(float), wide["volume"].to_numpy(float), regime, cluster


def _of_scenario(panel: DataFrame, scenarios: Iterable[Rules], pick, schema: str) -> DataFrame:
    """One group per scenario: the panel's rows are copied to each, so a scenario's task holds the panel once."""
    spark, names = panel.sparkSession, [f.name for f in fields(Rules)]
    table = spark.createDataFrame([tuple(asdict(r)[k] for k in names) for r in scenarios], names)
    packed = table.select("scenario", F.struct(*names).alias("rules"))
    needed = panel.select("date", "asset", "close", "volume", *[(F.col(c) if c in panel.columns else F.lit(None)).cast(k).alias(c) for c, k in (("regime", "double"), ("cluster", "int"))])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rules = Rules(**{k: rows["rules"].iloc[0][k] for k in names})
        dates, assets, price, volume, regime, cluster = _arrays(rows)
        return pick(assets, *fold(dates, price, volume, regime, cluster, rules)).assign(scenario=rules.scenario)

    return needed.crossJoin(F.broadcast(packed)).groupBy("scenario").applyInPandas(run, schema)  # a row per scenario is crossed


def daily(panel: DataFrame, scenarios: Iterable[Rules]) -> DataFrame:
    """The days of all scenarios over a dense panel (date, asset, close, volume[, regime, cluster])."""
    columns = [c.split()[0] for c in _DAY.split(", ")]
    return _of_scenario(panel, scenarios, lambda assets, days, trades: days.assign(scenario="")[columns], _DAY)


def trades(panel: DataFrame, scenarios: Iterable[Rules]) -> DataFrame:
    columns = [c.split()[0] for c in _TRADE.split(", ")]
    return _of_scenario(panel, scenarios, lambda assets, days, done: done.assign(scenario="", asset=[assets[int(a)] for a in done["asset"]])[columns], _TRADE)


def summary(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Indicators of each scenario, or of each of its windows, with how often caps bound and how much was traded."""
    from meridax.operators.portfolio import kpis, window_curves

    keys = keys or ["scenario"]
    about = days.groupBy(*keys).agg(F.avg(F.when(F.col("rebalanced"), F.col("cap_bound").cast("double"))).alias("cap_bind_rate"), F.avg("turnover").alias("turnover"), F.sum("cost").alias("cost"), F.count_if("killed").alias("killed_days"), F.count("*").alias("days"))
    return kpis(window_curves(days.select(*keys, "date", "ret"), keys), keys).join(about, keys)


def windows(days: DataFrame, train: int = 504, test: int = 126) -> DataFrame:
    """The days of each scenario with the out-of-sample window that they lie in; days of training and of an unfinished window go."""
    from pyspark.sql import Window

    own = Window.partitionBy("scenario")
    numbered = days.withColumn("i", F.row_number().over(own.orderBy("date")) - 1).withColumn("n", F.count("*").over(own))
    return numbered.where((F.col("i") >= train) & (F.col("i") < train + test * F.floor((F.col("n") - train) / test))).withColumn("window_id", F.floor((F.col("i") - train) / test)).drop("i", "n")
