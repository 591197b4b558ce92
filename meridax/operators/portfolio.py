"""Universe, covariance, weights, risk and costs on long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridax.functions.series import by_date, by_time, filled, rolling


def adv(grid: DataFrame, n: int = 20) -> DataFrame:
    """Average volume of n rows, all present; other rows go."""
    return grid.select("date", "asset", rolling(F.avg, F.col("volume"), n).alias("adv")).where("adv is not null")


def ages(panel: DataFrame) -> DataFrame:
    return panel.withColumn("age", F.row_number().over(by_time()))


def snapshots(panel: DataFrame, schedule: DataFrame, n: int) -> DataFrame:
    """For each scheduled date the panel with adv and age at the last traded date not after it (as of)."""
    from meridax.sources.panel import grid

    traded = panel.select("date").distinct()
    spine = schedule.select(F.col("rebalance_date").alias("at"), F.lit(None).cast("date").alias("date")).unionByName(traded.select(F.col("date").alias("at"), "date"))
    asof = spine.withColumn("date", F.max("date").over(Window.orderBy("at"))).select(F.col("at").alias("rebalance_date"), "date").join(schedule, "rebalance_date", "left_semi").distinct()
    facts = ages(panel).join(adv(grid(panel), n), ["date", "asset"], "left")
    return asof.join(facts, "date")


def candidates(snap: DataFrame, *, top_n: int = 20, adv_min: float = 0, price_min: float = 0, age_min: int = 20) -> DataFrame:
    ok = snap.where(f"close is not null and volume is not null and adv is not null and close >= {price_min} and adv >= {adv_min} and age >= {age_min}")
    rank = F.row_number().over(Window.partitionBy("rebalance_date").orderBy(F.desc("adv"), "asset"))
    return ok.withColumn("rank", rank).where(F.col("rank") <= top_n)


def universe(hits: DataFrame, schedule: DataFrame, hysteresis: int = 2) -> DataFrame:
    """(rebalance_date, asset) active after ``hysteresis`` hits in a row and until as many misses in a row: the last such event decides."""
    grid = schedule.select("rebalance_date").crossJoin(hits.select("asset").distinct()).join(hits.select("rebalance_date", "asset", F.lit(1).alias("hit")), ["rebalance_date", "asset"], "left")
    by = Window.partitionBy("asset").orderBy("rebalance_date")
    recent = F.sum(F.coalesce("hit", F.lit(0))).over(by.rowsBetween(-(hysteresis - 1), 0))
    full = F.count(F.lit(1)).over(by.rowsBetween(-(hysteresis - 1), 0)) == hysteresis
    event = F.when(full & (recent == hysteresis), 1).when(full & (recent == 0), 0)
    active = F.last("event", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn("event", event).withColumn("active", active).where("active = 1").select("rebalance_date", "asset")


def _both_ways(triangle: DataFrame) -> DataFrame:
    """A symmetric table from the pairs with asset_i <= asset_j."""
    i, j = F.col("asset_i"), F.col("asset_j")
    pair = lambda x, y: F.struct(x.alias("asset_i"), y.alias("asset_j"))
    ways = F.when(i == j, F.array(pair(i, j))).otherwise(F.array(pair(i, j), pair(j, i)))
    rest = [c for c in triangle.columns if c not in ("asset_i", "asset_j")]
    return triangle.withColumn("way", F.explode(ways)).select(*[c for c in rest if c != "cov"], "way.asset_i", "way.asset_j", "cov")


def rolling_cov(returns: DataFrame, n: int, dates: DataFrame) -> DataFrame:
    """Sample covariances (date, asset_i, asset_j) of the last n rows at ``dates``, of assets with all n values. Pairs are formed per target date only."""
    calendar = returns.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))
    ends = calendar.join(dates, "date").select(F.col("date").alias("end"), F.col("t").alias("te"))
    slices = ends.join(calendar, (F.col("t") <= F.col("te")) & (F.col("t") > F.col("te") - n)).select("end", "date")
    rows = slices.join(returns, "date").where("ret is not null")
    full = rows.withColumn("n", F.count("*").over(Window.partitionBy("end", "asset"))).where(F.col("n") == n)
    a, b = full.select("end", "date", F.col("asset").alias("asset_i"), F.col("ret").alias("x")), full.select("end", "date", F.col("asset").alias("asset_j"), F.col("ret").alias("y"))
    return _both_ways(a.join(b, ["end", "date"]).where("asset_i <= asset_j").groupBy(F.col("end").alias("date"), "asset_i", "asset_j").agg(F.covar_samp("x", "y").alias("cov")))


def shrunk(cov: DataFrame, kind: str = "diagonal", strength: float = 0.1) -> DataFrame:
    """Towards the diagonal, the mean variance, or constant correlation."""
    s = min(1.0, max(0.0, strength))
    diagonal = F.col("asset_i") == F.col("asset_j")
    if kind == "diagonal":
        target = F.when(diagonal, F.col("cov")).otherwise(0.0)
    elif kind == "identity":
        target = F.when(diagonal, F.avg(F.when(diagonal, F.col("cov"))).over(by_date())).otherwise(0.0)
    elif kind == "constant_correlation":
        variance = cov.where(diagonal).select("date", F.col("asset_i").alias("k"), F.col("cov").alias("var"))
        cov = cov.join(variance.select("date", F.col("k").alias("asset_i"), F.col("var").alias("vi")), ["date", "asset_i"]).join(variance.select("date", F.col("k").alias("asset_j"), F.col("var").alias("vj")), ["date", "asset_j"])
        scale = F.sqrt(F.col("vi") * F.col("vj"))
        target = F.when(diagonal, F.col("cov")).otherwise(F.avg(F.when(~diagonal, F.try_divide(F.col("cov"), scale))).over(by_date()) * scale)
    else:
        raise ValueError(f"unknown shrinkage: {kind}")
    return cov.select("date", "asset_i", "asset_j", ((1 - s) * F.col("cov") + s * target).alias("cov"))


def ewma_cov(returns: DataFrame, decay: float) -> DataFrame:
    """Weighted covariance over all rows of ``returns`` (complete), newest weight 1, weights normalised, means weighted."""
    t = returns.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)
    w = t.withColumn("w", F.pow(F.lit(decay), F.col("t"))).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy()))
    rows = returns.join(w.select("date", "w"), "date").withColumn("d", F.col("ret") - F.sum(F.col("ret") * F.col("w")).over(Window.partitionBy("asset")))
    a, b = rows.select("date", "w", F.col("asset").alias("asset_i"), F.col("d").alias("x")), rows.select("date", F.col("asset").alias("asset_j"), F.col("d").alias("y"))
    return _both_ways(a.join(b, "date").where("asset_i <= asset_j").groupBy("asset_i", "asset_j").agg(F.sum(F.col("w") * F.col("x") * F.col("y")).alias("cov")))


def inverse_risk(weights: DataFrame) -> DataFrame:
    """(date, asset, weight, atr): weight over risk, missing or zero risk counts 0, absolute weights sum to 1."""
    raw = F.coalesce(F.try_divide("weight", F.nullif("atr", F.lit(0.0))), F.lit(0.0))
    return weights.withColumn("raw", raw).select("date", "asset", F.try_divide("raw", F.sum(F.abs("raw")).over(by_date())).alias("weight"))


def capped(weights: DataFrame, cap: float, cluster_cap: float | None = None) -> DataFrame:
    """(date, asset, weight[, cluster]): clip to the cap on both sides, scale clusters above theirs, spread what is missing
    or over equally on the assets below the cap, then scale to a sum of 1 (caps may be exceeded by that)."""
    clipped = weights.withColumn("c", F.least(F.greatest("weight", F.lit(-cap)), F.lit(cap)))
    if cluster_cap is not None:
        held = F.abs(F.sum("c").over(Window.partitionBy("date", "cluster")))
        clipped = clipped.withColumn("c", F.when(F.col("cluster").isNotNull() & (held > cluster_cap), F.col("c") * cluster_cap / held).otherwise(F.col("c")))
    clipped = clipped.withColumn("free", (F.abs("c") < cap).cast("int"))
    rest = 1 - F.sum("c").over(by_date())
    spread = clipped.withColumn("c", F.col("c") + F.when((F.col("free") == 1), F.try_divide(rest, F.sum("free").over(by_date()))).otherwise(0.0))
    return spread.select("date", "asset", F.try_divide("c", F.sum("c").over(by_date())).alias("weight"))


def turnover_capped(pairs: DataFrame, cap: float = 0.25) -> DataFrame:
    """(date, asset, prev, new): move at most ``cap`` of turnover towards new weights, then scale to a sum of 1."""
    turn = F.sum(F.abs(F.col("new") - F.col("prev"))).over(by_date()) / 2
    moved = F.when(turn > cap, F.col("prev") + (F.col("new") - F.col("prev")) * cap / turn).otherwise(F.col("new"))
    return pairs.withColumn("m", moved).select("date", "asset", F.try_divide("m", F.sum("m").over(by_date())).alias("weight"))


def costs(trades: DataFrame, *, bps: float = 5, k: float = 0.1, most_bps: float = 50) -> DataFrame:
    """(.., notional, adv): commission and slippage by participation."""
    share = F.try_divide(F.abs("notional"), F.col("adv"))
    rate = F.least(F.lit(most_bps), k * 1e4 * share)
    return trades.withColumns({"fees": F.abs("notional") * bps / 1e4, "slip": F.abs("notional") * rate / 1e4})


def drawdowns(curve: DataFrame) -> DataFrame:
    """(asset, date, equity) with the drawdown from the running peak."""
    return curve.withColumn("dd", F.col("equity") / F.max("equity").over(by_time().rowsBetween(Window.unboundedPreceding, 0)) - 1)


def window_curves(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, ret) with each window's own equity and drawdown: growth and peak begin anew in every window."""
    by = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # a return of -100 % or less has no logarithm: from there on the equity is 0
    grown = F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)).over(by))
    lost = F.max((F.col("ret") <= -1).cast("int")).over(by) == 1
    curve = returns.withColumn("equity", F.when(lost, 0.0).otherwise(grown))
    return curve.withColumn("dd", F.col("equity") / F.max("equity").over(by) - 1)


def kpis(returns: DataFrame, keys: list[str], periods: int = 252) -> DataFrame:
    """(keys, date, ret, equity): performance by group. The span counts rows, not steps."""
    first, last, n = F.min_by("equity", "date"), F.max_by("equity", "date"), F.count("*")
    mean, deviation = F.avg("ret"), F.stddev_pop("ret")
    down = F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret")))
    return returns.groupBy(*keys).agg(
        (F.try_divide(mean * periods, deviation * F.sqrt(F.lit(float(periods))))).alias("sharpe"),
        (F.try_divide(mean * periods, down * F.sqrt(F.lit(float(periods))))).alias("sortino"),
        (F.pow(last / first, periods / n) - 1).alias("cagr"),
        (deviation * F.sqrt(F.lit(float(periods)))).alias("vol"),
        F.min("dd").alias("mdd"),
        F.try_divide(F.count_if(F.col("ret") > 0).cast("double"), F.count_if(F.col("ret") != 0)).alias("hit_rate"),
    )


def underwater(curve: DataFrame) -> DataFrame:
    """Lengths of spells below the peak that ended: average and longest, by asset."""
    flags = drawdowns(curve).withColumn("under", (F.col("dd") < -1e-12).cast("int"))
    islands = flags.withColumn("island", F.sum(1 - F.col("under")).over(by_time())).withColumn("newest", F.max("island").over(Window.partitionBy("asset")))
    ended = (F.col("under") == 1) & ((F.col("island") < F.col("newest")))
    spells = islands.where(ended).groupBy("asset", "island").agg(F.count("*").alias("n"))
    return curve.select("asset").distinct().join(spells, "asset", "left").groupBy("asset").agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_tuw"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_tuw"))


def last_filled(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn(column, filled(F.col(column)))
