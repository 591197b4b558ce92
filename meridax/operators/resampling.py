"""Block resampling of return series: sign-flip permutation p-values and moving-block bootstrap intervals.

Replicates are the parallel axis: a series (one row per date) goes to ``parts`` tasks, each of which computes its share. A
replicate's draws depend on the seed and its number only, so that results don't depend on ``parts`` or on lost executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sharpe(returns: np.ndarray, periods: int = 252) -> float:
    """Annualised mean over population deviation; NaN for constant series."""
    dev = returns.std() if len(returns) else 0.0
    return float(returns.mean() / dev * np.sqrt(periods)) if dev > 0 else float("nan")


def flipped(values: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """Consecutive blocks drawn with replacement, each with a random sign, cut to the length of ``values``."""
    n = -(-len(values) // block)
    drawn, signs = rng.integers(0, n, n), rng.choice((-1.0, 1.0), n)
    return np.concatenate([values[i * block : (i + 1) * block] * s for i, s in zip(drawn, signs)])[: len(values)]


def moved(values: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks from any start, cut to the length of ``values``."""
    begins = rng.integers(0, len(values) - block + 1, -(-len(values) // block))
    return values[(begins[:, None] + np.arange(block)).ravel()[: len(values)]]


def replicates(series: DataFrame, draw, *, count: int, block: int, seed: int, parts: int = 8, periods: int = 252) -> DataFrame:
    """(asset, replicate, actual, sharpe, cagr, mdd) from (asset, date, ret); null returns are left out, NaN becomes null."""

    def kernel(key, rows: pd.DataFrame) -> pd.DataFrame:
        values, out = rows.sort_values("date")["ret"].to_numpy(), []
        size = max(1, min(block, len(values)))
        for k in range(key[1], count, parts):
            sample = draw(values, size, np.random.default_rng([seed, k]))
            equity = np.cumprod(1 + sample)
            cagr = equity[-1] ** (periods / len(sample)) - 1 if equity[-1] > 0 else float("nan")
            out.append((key[0], k, sharpe(values, periods), sharpe(sample, periods), cagr, float((equity / np.maximum.accumulate(equity) - 1).min())))
        return pd.DataFrame(out, columns=["asset", "replicate", "actual", "sharpe", "cagr", "mdd"])

    dealt = series.where("ret is not null and not isnan(ret)").select("asset", "date", "ret", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    out = dealt.groupBy("asset", "part").applyInPandas(kernel, "asset string, replicate int, actual double, sharpe double, cagr double, mdd double")
    return out.select("asset", "replicate", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("actual", "sharpe", "cagr", "mdd")])


def permutation_pvalues(series: DataFrame, *, count: int = 1000, block: int = 21, seed: int = 0, trials: int = 1) -> DataFrame:
    """(asset, actual, n, p_value, deflated_p): ``(exceeding + 1) / (n + 1)`` and ``1 - (1 - p) ^ trials``."""
    made = replicates(series, flipped, count=count, block=block, seed=seed).where("actual is not null")
    agg = made.groupBy("asset", "actual").agg(F.count("sharpe").alias("n"), F.count_if(F.col("sharpe") >= F.col("actual")).alias("exceed"))
    p = F.when(F.col("n") > 0, (F.col("exceed") + 1) / (F.col("n") + 1))
    return agg.select("asset", "actual", "n", p.alias("p_value"), (1 - F.pow(1 - p, F.lit(trials))).alias("deflated_p"))


def bootstrap_intervals(series: DataFrame, *, count: int = 1000, block: int = 21, seed: int = 42) -> DataFrame:
    """(asset, metric, low, mid, high): the 2.5, 50 and 97.5 % quantiles of Sharpe, growth and drawdown."""
    long = replicates(series, moved, count=count, block=block, seed=seed).unpivot(["asset"], ["sharpe", "cagr", "mdd"], "metric", "x")
    cut = F.percentile("x", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return long.groupBy("asset", "metric").agg(cut.alias("q")).select("asset", "metric", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("low", "mid", "high"))])
