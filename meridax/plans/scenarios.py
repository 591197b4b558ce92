"""Registered backtests: one fold, and tables of scenarios over it. They have no SQL; the tests hold the fold against plain cases."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridax.operators import backtest as B
from meridax.plans.queries import _daily, query, regime_frame

BASE = B.Rules(target_vol=0.12, mdd_limit=-0.6, vol_multiple=40.0)  # brand prices swing far more than shares: wide stops


def panel(s, d) -> DataFrame:
    """The dense daily panel with the regime of each date's month (0 where unknown)."""
    months = F.broadcast(regime_frame(s, d).select(F.col("date").alias("month"), "regime"))  # a row per month
    grid = _daily(s, d).withColumn("month", F.to_date(F.trunc("date", "month")))
    return grid.join(months, "month", "left").select("date", "asset", "close", "volume", F.coalesce("regime", F.lit(0.0)).alias("regime"))


def grid(**axes) -> list[B.Rules]:
    """All combinations of the given rules, each a scenario named by them."""
    return [replace(BASE, scenario=",".join(f"{k}={v}" for k, v in zip(axes, values)), **dict(zip(axes, values))) for values in product(*axes.values())]


MODES = grid(method=["hrp", "hrp_only", "tda_only"])
CAPS = [replace(r, asset_cap_high=r.asset_cap) for r in grid(asset_cap=[0.05, 0.1, 0.2, 0.4])]


@query("backtest_daily")
def backtest_daily(s, d):
    return B.daily(panel(s, d), [BASE])


@query("backtest_trades")
def backtest_trades(s, d):
    return B.trades(panel(s, d), [BASE])


@query("backtest_modes")
def backtest_modes(s, d):
    return B.summary(B.daily(panel(s, d), MODES))


@query("backtest_walkforward")
def backtest_walkforward(s, d):
    """Indicators of each mode in each out-of-sample window."""
    return B.summary(B.windows(B.daily(panel(s, d), MODES)), ["scenario", "window_id"])


@query("capacity_curve")
def capacity_curve(s, d):
    return B.summary(B.windows(B.daily(panel(s, d), CAPS)))


@query("cost_stress")
def cost_stress(s, d):
    return B.summary(B.windows(B.daily(panel(s, d), grid(cost_multiple=[0.5, 1.0, 2.0, 3.0]))))


@query("sensitivity_matrix")
def sensitivity_matrix(s, d):
    """Sharpe ratios by target volatility and turnover cap, as a matrix."""
    scenarios = grid(target_vol=[0.08, 0.12, 0.16], turnover_cap=[0.1, 0.25, 0.5])
    cells = B.summary(B.windows(B.daily(panel(s, d), scenarios)))
    part = lambda k: F.regexp_extract("scenario", rf"{k}=([\d.]+)", 1)
    return cells.select(part("target_vol").alias("target_vol"), part("turnover_cap").alias("cap"), "sharpe").groupBy("target_vol").pivot("cap", ["0.1", "0.25", "0.5"]).agg(F.first("sharpe")).toDF("target_vol", "cap_10", "cap_25", "cap_50")


@query("kill_switch_grid")
def kill_switch_grid(s, d):
    return B.summary(B.daily(panel(s, d), grid(mdd_limit=[-0.1, -0.3, -0.6], vol_multiple=[2.0, 40.0], reset_days=[5, 21])))


@query("regime_subperiods")
def regime_subperiods(s, d):
    """Indicators of the days above and below the median regime."""
    days = B.daily(panel(s, d), [BASE])
    months = regime_frame(s, d).select(F.col("date").alias("month"), "regime")
    middle = months.withColumn("middle", F.percentile("regime", F.lit(0.5)).over(Window.partitionBy()))  # a row per month
    part = days.withColumn("month", F.to_date(F.trunc("date", "month"))).join(F.broadcast(middle), "month")
    return B.summary(part.withColumn("part", F.when(F.col("regime") > F.col("middle"), "high").otherwise("low")), ["part"])


@query("cap_telemetry")
def cap_telemetry(s, d):
    """How often caps bound, by scenario and year."""
    days = B.daily(panel(s, d), CAPS).where("rebalanced")
    return days.groupBy("scenario", F.year("date").alias("year")).agg(F.count("*").alias("rebalances"), F.avg(F.col("cap_bound").cast("double")).alias("bind_rate"), F.sum("asset_hits").alias("asset_hits"), F.avg("turnover").alias("turnover"))


def tuned(s, d, stages: list[dict[str, list]]) -> DataFrame:
    """Stage by stage: each varies its rules on the best scenario of the one before (highest out-of-sample Sharpe ratio); all results, the best of each stage marked."""
    best, out, frame = BASE, None, panel(s, d)
    for number, axes in enumerate(stages):
        scenarios = [replace(best, scenario=",".join(f"{k}={v}" for k, v in zip(axes, values)), **dict(zip(axes, values))) for values in product(*axes.values())]
        rows = B.summary(B.windows(B.daily(frame, scenarios))).select("scenario", "sharpe", "mdd").collect()  # a row per scenario
        rows = sorted(rows, key=lambda r: (-(r.sharpe if r.sharpe is not None else float("-inf")), r.scenario))
        best = next(r for r in scenarios if r.scenario == rows[0].scenario)
        stage = s.createDataFrame([(number, r.scenario, r.sharpe, r.mdd, i == 0) for i, r in enumerate(rows)], "stage int, scenario string, sharpe double, mdd double, best boolean")
        out = stage if out is None else out.unionByName(stage)
    return out


@query("staged_tuning")
def staged_tuning(s, d):
    return tuned(s, d, [{"target_vol": [0.08, 0.12, 0.16]}, {"turnover_cap": [0.1, 0.25]}])
