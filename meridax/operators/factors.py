"""Factors over a dense panel: time windows first, then cross-sections, so that rows move twice at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridax.functions.series import back_filled, by_date, by_time, filled, lag_return, last_rows, rolling, winsorized, zscore


def forward_returns(grid: DataFrame, horizon: int = 21) -> DataFrame:
    ahead = F.lead("close", horizon).over(by_time())
    return grid.select("date", "asset", (F.try_divide(ahead, F.col("close")) - 1).alias("fwd"))


def momentum(grid: DataFrame, long: int = 252, short: int = 21) -> DataFrame:
    """Return from ``long`` to ``short`` rows ago, z-scored over the assets of each date; dates without any value go."""
    raw = grid.select("date", "asset", (F.try_divide(F.lag("close", short).over(by_time()), F.lag("close", long).over(by_time())) - 1).alias("raw"))
    return raw.withColumn("any", F.count("raw").over(by_date())).where("any > 0").select("date", "asset", zscore(F.col("raw")).alias("momentum"))


def slope(grid: DataFrame, n: int = 63) -> DataFrame:
    """Least-squares slope of the log price over n rows, z-scored; null if one price is missing."""
    numbered = grid.select("date", "asset", F.ln("close").alias("y"), F.row_number().over(by_time()).alias("x"))
    fit = F.when(F.count("y").over(last_rows(n)) == n, F.regr_slope(F.col("y"), F.col("x")).over(last_rows(n)))
    return numbered.withColumn("raw", fit).select("date", "asset", zscore(F.col("raw")).alias("slope"))


def quality(grid: DataFrame, vol: int = 21, peak: int = 126) -> DataFrame:
    """Less volatility, plus the share of rises, less drawdown (which is negative, so that deep ones score higher), z-scored."""
    padded = grid.withColumn("p", filled(F.col("close"))).withColumn("r", F.try_divide(F.col("p"), F.lag("p").over(by_time())) - 1)
    parts = padded.select(
        "date",
        "asset",
        rolling(F.stddev_pop, F.col("r"), vol).alias("v"),
        (F.try_divide(F.col("close"), F.max("close").over(last_rows(peak))) - 1).alias("dd"),
        rolling(F.avg, F.signum("r"), vol).alias("up"),
    )
    raw = -0.5 * filled(F.col("v")) - 0.3 * F.coalesce("dd", F.lit(0.0)) + 0.2 * F.coalesce("up", F.lit(0.0))
    return parts.withColumn("raw", raw).select("date", "asset", zscore(F.col("raw")).alias("quality"))


def mix(scores: DataFrame, *, alpha: float = 0.6, beta: float = 0.3, gamma: float = 0.1, delta: float = 0.0, gain: float = 1.0, mode: str = "tanh") -> DataFrame:
    """(date, asset, regime, momentum, quality[, periphery]) to a score that leans on momentum as the regime rises, winsorised per date.

    Scores are carried forward over the dates that all inputs share; dates on which one of them is null for all assets go.
    The regime is carried forward, then backward. An unknown ``mode`` counts as tanh.
    """
    if not alpha > beta >= gamma:
        raise ValueError("weights must satisfy alpha > beta >= gamma")
    carried = [c for c in ("momentum", "quality", "periphery") if c in scores.columns]
    scores = scores.withColumns({c: filled(F.col(c)) for c in carried}).withColumn("regime", F.coalesce(filled(F.col("regime")), back_filled(F.col("regime"))))
    held = scores.withColumns({f"__n_{c}": F.count(c).over(by_date()) for c in carried})
    scores = held.where(" and ".join(f"__n_{c} > 0" for c in carried) + " and regime is not null")
    r = F.least(F.greatest(F.col("regime"), F.lit(0.0)), F.lit(1.0))
    level = {"tanh": 0.5 * (1 + F.tanh(gain * 2 * (r - 0.5))), "power": F.pow(r, F.lit(max(1e-6, gain))), "linear": r}
    level = level.get(mode, level["tanh"])
    periphery = delta * F.coalesce("periphery", F.lit(0.0)) if "periphery" in scores.columns else F.lit(0.0)
    raw = scores.withColumn("raw", alpha * level * F.col("momentum") + (beta * level + gamma * (1 - level)) * F.col("quality") + periphery)
    return raw.select("date", "asset", winsorized(F.col("raw")).alias("score"))


def atr(grid: DataFrame, n: int = 14) -> DataFrame:
    padded = grid.withColumn("p", filled(F.col("close"))).withColumn("r", F.abs(F.try_divide(F.col("p"), F.lag("p").over(by_time())) - 1))
    return padded.select("date", "asset", rolling(F.avg, F.col("r"), n).alias("atr"))


def simple_returns(grid: DataFrame) -> DataFrame:
    return grid.select("date", "asset", lag_return(F.col("close")).alias("ret"))


def padded_returns(grid: DataFrame) -> DataFrame:
    padded = grid.withColumn("p", filled(F.col("close")))
    return padded.select("date", "asset", (F.try_divide(F.col("p"), F.lag("p").over(by_time())) - 1).alias("ret"))
