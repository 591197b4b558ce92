"""Registered queries over the panels, each beside SQL for an independent engine that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridax.functions.series import by_date, by_time, back_filled, clamp, ewm, filled, lag_return, rolling, softmax, winsorized, zscore
from meridax.operators import factors, graphs, portfolio, resampling
from meridax.sources import panel as P
from meridax.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- the same panels in SQL
_P = """daily as (select cast(l_shipdate as date) as date, p_brand as asset, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close,
 cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume from lineitem join part on l_partkey = p_partkey group by 1, 2),
monthly as (select cast(date_trunc('month', l_shipdate) as date) as date, p_brand as asset, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close,
 cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume from lineitem join part on l_partkey = p_partkey group by 1, 2),
dgrid as (select d.date, a.asset, p.close, p.volume from (select distinct date from daily) d cross join (select distinct asset from daily) a left join daily p on p.date = d.date and p.asset = a.asset),
mgrid as (select d.date, a.asset, p.close, p.volume from (select distinct date from monthly) d cross join (select distinct asset from monthly) a left join monthly p on p.date = d.date and p.asset = a.asset),
dfill as (select *, last_value(close ignore nulls) over (partition by asset order by date rows between unbounded preceding and current row) as p from dgrid),
mfill as (select *, last_value(close ignore nulls) over (partition by asset order by date rows between unbounded preceding and current row) as p from mgrid),
mret as (select *, close / lag(close) over (partition by asset order by date) - 1 as ret from mgrid),
mpad as (select *, p / lag(p) over (partition by asset order by date) - 1 as ret from mfill),
dpad as (select *, p / lag(p) over (partition by asset order by date) - 1 as ret from dfill)"""
_Z = "case when {x} is not null then case when stddev_pop({x}) over (partition by date) > 0 then ({x} - avg({x}) over (partition by date)) / stddev_pop({x}) over (partition by date) else 0 end end"


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; ``sql`` continues after the panels' common table expressions."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: _round(function(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql if sql.lstrip().startswith("with ") else f"with {_P} {sql}"
        return function

    return add


_daily = lambda s, d: P.grid(P.daily(s, d))
_monthly = lambda s, d: P.grid(P.monthly(s, d))


@query("panel_daily", "select date, asset, round(close, 9) as close, round(volume, 9) as volume from daily", digits=9)
def panel_daily(s, d):
    return P.daily(s, d)


@query("panel_monthly", "select date, asset, round(close, 9) as close, round(volume, 9) as volume from monthly", digits=9)
def panel_monthly(s, d):
    return P.monthly(s, d)


@query("panel_segment", "select cast(o_orderdate as date) as date, c_mktsegment as asset, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*), 6) as close, cast(count(*) as double) as volume from orders join customer on o_custkey = c_custkey group by 1, 2")
def panel_segment(s, d):
    return P.segments(s, d)


@query("grid_dense", "select date, asset, round(close, 9) as close, volume from dgrid", digits=9)
def grid_dense(s, d):
    return _daily(s, d).select("date", "asset", "close", "volume")


@query("returns_simple", "select date, asset, round(close / lag(close) over (partition by asset order by date) - 1, 6) as ret from dgrid")
def returns_simple(s, d):
    return factors.simple_returns(_daily(s, d))


@query("returns_padded", "select date, asset, round(ret, 6) as ret from dpad")
def returns_padded(s, d):
    return factors.padded_returns(_daily(s, d))


@query("returns_zero_filled", "select date, asset, round(coalesce(close / lag(close) over (partition by asset order by date) - 1, 0), 6) as ret from dgrid")
def returns_zero_filled(s, d):
    return _daily(s, d).select("date", "asset", F.coalesce(lag_return(F.col("close")), F.lit(0.0)).alias("ret"))


@query("adv_5", "select * from (select date, asset, case when count(volume) over w = 5 then round(avg(volume) over w, 6) end as adv from mgrid window w as (partition by asset order by date rows between 4 preceding and current row)) where adv is not null")
def adv_5(s, d):
    return portfolio.adv(_monthly(s, d), 5)


@query("adv_notional", "select date, asset, round(adv * close, 6) as notional from (select *, case when count(volume) over w = 5 then avg(volume) over w end as adv from mgrid window w as (partition by asset order by date rows between 4 preceding and current row)) where adv is not null")
def adv_notional(s, d):
    g = _monthly(s, d)
    return portfolio.adv(g, 5).join(g, ["date", "asset"]).select("date", "asset", (F.col("adv") * F.col("close")).alias("notional"))


@query("asset_age", "select date, asset, cast(row_number() over (partition by asset order by date) as integer) as age from daily")
def asset_age(s, d):
    return portfolio.ages(P.daily(s, d)).select("date", "asset", "age")


@query("ffill_close", "select date, asset, round(p, 9) as close from dfill", digits=9)
def ffill_close(s, d):
    return _daily(s, d).select("date", "asset", filled(F.col("close")).alias("close"))


@query("bfill_close", "select date, asset, round(first_value(close ignore nulls) over (partition by asset order by date rows between current row and unbounded following), 9) as close from dgrid", digits=9)
def bfill_close(s, d):
    return _daily(s, d).select("date", "asset", back_filled(F.col("close")).alias("close"))


@query("forward_returns_21", "select date, asset, round(lead(close, 21) over (partition by asset order by date) / close - 1, 6) as fwd from dgrid")
def forward_returns_21(s, d):
    return factors.forward_returns(_daily(s, d), 21)


_MOM = f"""mraw as (select date, asset, lag(close, 1) over (partition by asset order by date) / lag(close, 12) over (partition by asset order by date) - 1 as raw from mgrid),
mmom as (select date, asset, {_Z.format(x='raw')} as momentum from mraw where date in (select date from mraw where raw is not null))"""


@query("momentum_12_1", f", {_MOM} select date, asset, round(momentum, 6) as momentum from mmom")
def momentum_12_1(s, d):
    return factors.momentum(_monthly(s, d), 12, 1)


@query("momentum_top5", f", {_MOM} select date, asset, round(momentum, 6) as momentum, cast(rank as integer) as rank from (select *, row_number() over (partition by date order by momentum desc, asset) as rank from mmom where momentum is not null) where rank <= 5")
def momentum_top5(s, d):
    best = Window.partitionBy("date").orderBy(F.desc("momentum"), "asset")
    return factors.momentum(_monthly(s, d), 12, 1).where("momentum is not null").withColumn("rank", F.row_number().over(best)).where("rank <= 5")


@query("slope_12", f""", n as (select date, asset, ln(close) as y, row_number() over (partition by asset order by date) as x from mgrid),
 f as (select date, asset, case when count(y) over w = 12 then regr_slope(y, x) over w end as raw from n window w as (partition by asset order by date rows between 11 preceding and current row))
 select date, asset, round({_Z.format(x='raw')}, 6) as slope from f""")
def slope_12(s, d):
    return factors.slope(_monthly(s, d), 12)


_QUAL = f"""qparts as (select date, asset, case when count(ret) over v = 6 then stddev_pop(ret) over v end as vol, close / max(close) over (partition by asset order by date rows between 11 preceding and current row) - 1 as dd, case when count(sign(ret)) over v = 6 then avg(sign(ret)) over v end as up from mpad window v as (partition by asset order by date rows between 5 preceding and current row)),
qraw as (select date, asset, -0.5 * last_value(vol ignore nulls) over (partition by asset order by date rows between unbounded preceding and current row) - 0.3 * coalesce(dd, 0) + 0.2 * coalesce(up, 0) as raw from qparts),
mqual as (select date, asset, {_Z.format(x='raw')} as quality from qraw)"""


@query("quality_6", f", {_QUAL} select date, asset, round(quality, 6) as quality from mqual")
def quality_6(s, d):
    return factors.quality(_monthly(s, d), 6, 12)


_MARKET = """market as (select date, avg(ret) as m from mpad group by date),
base as (select date, stddev_pop(m) over (order by date rows between 5 preceding and current row) as b, count(m) over (order by date rows between 5 preceding and current row) as n from market),
series as (select date, row_number() over (order by date) as i, case when n = 6 then b end as b from base)"""
_REG = f"""{_MARKET}, known as (select date, b, row_number() over (order by date) as i from series where b is not null),
ew as (select k.date, k.i, (select sum(o.b * case when o.i = 1 then pow(1 - 2.0 / 4, k.i - 1) else (2.0 / 4) * pow(1 - 2.0 / 4, k.i - o.i) end) from known o where o.i <= k.i) as e from known k),
zs as (select date, case when count(e) over w = 12 and stddev_pop(e) over w > 0 then (e - avg(e) over w) / stddev_pop(e) over w end as z from ew window w as (order by date rows between 11 preceding and current row)),
regime as (select date, z, coalesce(least(greatest((z - 0.58) / 1.22, 0), 1), 0) as regime, coalesce(z >= 0.58, false) as is_alert, coalesce(z >= 1.8, false) as is_riskoff from zs)"""


def regime_frame(s, d) -> DataFrame:
    """A turbulence index of the monthly market: deviation of its mean return, smoothed, z-scored, scaled between two thresholds."""
    by = Window.orderBy("date")  # one row per month
    market = factors.padded_returns(_monthly(s, d)).groupBy("date").agg(F.avg("ret").alias("m"))
    base = market.select("date", rolling(F.stddev_pop, F.col("m"), 6, window=by).alias("b")).where("b is not null")
    smooth = base.select("date", ewm(F.col("b"), 3, by).alias("e"))
    frame = by.rowsBetween(-11, 0)
    deviation = F.stddev_pop("e").over(frame)
    z = smooth.select("date", F.when((F.count("e").over(frame) == 12) & (deviation > 0), (F.col("e") - F.avg("e").over(frame)) / deviation).alias("z"))
    return z.select("date", "z", F.coalesce(clamp((F.col("z") - 0.58) / 1.22, 0.0, 1.0), F.lit(0.0)).alias("regime"), F.coalesce(F.col("z") >= 0.58, F.lit(False)).alias("is_alert"), F.coalesce(F.col("z") >= 1.8, F.lit(False)).alias("is_riskoff"))


@query("regime_index", f", {_REG} select date, round(z, 6) as z, round(regime, 6) as regime, is_alert, is_riskoff from regime")
def regime_index(s, d):
    return regime_frame(s, d)


@query("ewm_3", f", {_REG} select date, round(e, 6) as e from ew")
def ewm_3(s, d):
    by = Window.orderBy("date")
    market = factors.padded_returns(_monthly(s, d)).groupBy("date").agg(F.avg("ret").alias("m"))
    return market.select("date", rolling(F.stddev_pop, F.col("m"), 6, window=by).alias("b")).where("b is not null").select("date", ewm(F.col("b"), 3, by).alias("e"))


def _scores(s, d):
    g = _monthly(s, d)
    both = factors.momentum(g, 12, 1).join(factors.quality(g, 6, 12), ["date", "asset"])
    return both.join(F.broadcast(regime_frame(s, d).select("date", "regime")), "date")  # a row per date


_LEVELS = {"tanh": "0.5 * (1 + tanh(1.0 * 2 * (regime - 0.5)))", "power": "pow(regime, 2.0)", "linear": "regime"}
for _mode, _level in _LEVELS.items():

    @query(
        f"mix_{_mode}",
        f""", {_MOM}, {_QUAL}, {_REG}, js as (select m.date, m.asset, regime, last_value(momentum ignore nulls) over w as momentum, last_value(quality ignore nulls) over w as quality from mmom m join mqual q on m.date = q.date and m.asset = q.asset join regime r on r.date = m.date window w as (partition by m.asset order by m.date rows between unbounded preceding and current row))
 , raws as (select date, asset, 0.6 * {_level} * momentum + (0.3 * {_level} + 0.1 * (1 - {_level})) * quality as raw from js qualify count(momentum) over (partition by date) > 0 and count(quality) over (partition by date) > 0)
 , q as (select date, quantile_cont(raw, 0.05) as lo, quantile_cont(raw, 0.95) as hi from raws group by date)
 select r.date, asset, case when raw is not null then round(least(greatest(raw, lo), hi), 6) end as score from raws r join q on q.date = r.date""",
    )
    def _mix(s, d, mode=_mode):
        return factors.mix(_scores(s, d), mode=mode, gain=2.0 if mode == "power" else 1.0)


@query("winsor_xs", "select g.date, g.asset, case when g.close is not null then round(least(greatest(g.close, lo), hi), 6) end as close from mgrid g join (select date, quantile_cont(close, 0.05) as lo, quantile_cont(close, 0.95) as hi from mgrid group by date) q on q.date = g.date")
def winsor_xs(s, d):
    return _monthly(s, d).select("date", "asset", winsorized(F.col("close")).alias("close"))


@query("zscore_xs", f"select date, asset, round({_Z.format(x='close')}, 6) as z from mgrid")
def zscore_xs(s, d):
    return _monthly(s, d).select("date", "asset", zscore(F.col("close")).alias("z"))


@query("softmax_xs", f", z as (select date, asset, {_Z.format(x='close')} as z from monthly), e as (select *, exp((z - max(z) over (partition by date)) / 0.7) as e from z) select date, asset, round(e / sum(e) over (partition by date), 6) as w from e")
def softmax_xs(s, d):
    return P.monthly(s, d).select("date", "asset", zscore(F.col("close")).alias("z")).select("date", "asset", softmax(F.col("z"), 0.7).alias("w"))


@query("atr_6", "select date, asset, case when count(ret) over w = 6 then round(avg(abs(ret)) over w, 6) end as atr from mpad window w as (partition by asset order by date rows between 5 preceding and current row)")
def atr_6(s, d):
    return factors.atr(_monthly(s, d), 6)


_ATR = "atrs as (select date, asset, case when count(ret) over w = 6 then avg(abs(ret)) over w end as atr from mpad window w as (partition by asset order by date rows between 5 preceding and current row)), inv as (select date, asset, case when atr > 0 then 1.0 / 25 / atr else 0 end as raw from atrs), invw as (select date, asset, raw / nullif(sum(abs(raw)) over (partition by date), 0) as weight from inv)"


def _inverse(s, d):
    return portfolio.inverse_risk(factors.atr(_monthly(s, d), 6).withColumn("weight", F.lit(1.0 / 25)))


@query("inv_atr_weights", f", {_ATR} select date, asset, round(weight, 6) as weight from invw")
def inv_atr_weights(s, d):
    return _inverse(s, d)


@query("caps_applied", f", {_ATR}, c as (select *, greatest(least(weight, 0.045), -0.045) as c, cast(abs(greatest(least(weight, 0.045), -0.045)) < 0.045 as int) as free from invw where weight is not null), r as (select *, c + case when free = 1 then (1 - sum(c) over (partition by date)) / nullif(sum(free) over (partition by date), 0) else 0 end as c2 from c) select date, asset, round(c2 / nullif(sum(c2) over (partition by date), 0), 6) as weight from r")
def caps_applied(s, d):
    return portfolio.capped(_inverse(s, d).where("weight is not null"), 0.045)


@query("turnover_capped", f", {_ATR}, t as (select date, asset, coalesce(lag(weight) over (partition by asset order by date), 0) as prev, coalesce(weight, 0) as new from invw), m as (select *, sum(abs(new - prev)) over (partition by date) / 2 as turn from t), n as (select *, case when turn > 0.05 then prev + (new - prev) * 0.05 / turn else new end as w from m) select date, asset, round(w / nullif(sum(w) over (partition by date), 0), 6) as weight from n")
def turnover_capped(s, d):
    w = _inverse(s, d).select("date", "asset", F.coalesce(F.lag("weight").over(by_time()), F.lit(0.0)).alias("prev"), F.coalesce("weight", F.lit(0.0)).alias("new"))
    return portfolio.turnover_capped(w, 0.05)


@query("turnover_daily", f", {_ATR} select date, round(sum(coalesce(abs(weight - prev), 0)) / 2, 6) as turnover from (select *, lag(weight) over (partition by asset order by date) as prev from invw) group by date")
def turnover_daily(s, d):
    w = _inverse(s, d).withColumn("prev", F.lag("weight").over(by_time()))
    return w.groupBy("date").agg((F.sum(F.coalesce(F.abs(F.col("weight") - F.col("prev")), F.lit(0.0))) / 2).alias("turnover"))


_ENDS = "ends as (select date as de, t as te from (select date, row_number() over (order by date) as t from (select distinct date from mgrid)) where t >= 12)"
_COV = f"""{_ENDS}, cal as (select date, row_number() over (order by date) as t from (select distinct date from mgrid)), slices as (select de, date from ends join cal on t <= te and t > te - 12),
srows as (select de, s.date, asset, ret from slices s join mpad m on m.date = s.date where ret is not null), full_ as (select * from (select *, count(*) over (partition by de, asset) as n from srows) where n = 12),
cov as (select a.de as date, a.asset as asset_i, b.asset as asset_j, covar_samp(a.ret, b.ret) as cov from full_ a join full_ b on a.de = b.de and a.date = b.date group by 1, 2, 3)"""


EVERY_MONTH = "t >= 12"  # of months numbered by t from 1: each that has a full window of 12


def _cov(s, d):
    g = _monthly(s, d)
    every = g.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date"))).where(EVERY_MONTH).select("date")
    return portfolio.rolling_cov(factors.padded_returns(g), 12, every)


@query("rolling_cov_pairs", f", {_COV} select date, asset_i, asset_j, round(cov, 8) as cov from cov")
def rolling_cov_pairs(s, d):
    return _cov(s, d)


QUERIES["rolling_cov_pairs"] = lambda s, d: _round(_cov(s, d), 8)


_SHRINKS = {
    "diagonal": "select date, asset_i, asset_j, round(case when asset_i = asset_j then cov else 0.8 * cov end, 8) as cov from cov",
    "identity": "select date, asset_i, asset_j, round(0.8 * cov + 0.2 * case when asset_i = asset_j then avg(case when asset_i = asset_j then cov end) over (partition by date) else 0 end, 8) as cov from cov",
    "constant_correlation": ", v as (select date, asset_i as k, cov as var from cov where asset_i = asset_j), j as (select c.*, sqrt(a.var * b.var) as sc from cov c join v a on a.date = c.date and a.k = asset_i join v b on b.date = c.date and b.k = asset_j) select date, asset_i, asset_j, round(0.8 * cov + 0.2 * case when asset_i = asset_j then cov else avg(case when asset_i <> asset_j then cov / sc end) over (partition by date) * sc end, 8) as cov from j",
}
for _kind, _sql in _SHRINKS.items():
    QUERIES[f"shrink_{_kind}"] = lambda s, d, kind=_kind: _round(portfolio.shrunk(_cov(s, d), kind, 0.2), 8)
    ORACLES[f"shrink_{_kind}"] = f"with {_P}, {_COV} {_sql}"


@query("ewma_cov", ", t as (select date, row_number() over (order by date desc) - 1 as t from (select distinct date from mpad where ret is not null)), w as (select date, pow(0.94, t) / sum(pow(0.94, t)) over () as w from t), c as (select r.date, asset, ret, w, ret - sum(ret * w) over (partition by asset) as d from mpad r join w on w.date = r.date where asset in (select asset from mpad group by asset having count(ret) = (select count(*) from w))) select a.asset as asset_i, b.asset as asset_j, round(sum(a.w * a.d * b.d), 8) as cov from c a join c b on a.date = b.date group by 1, 2")
def ewma_cov(s, d):
    r = factors.padded_returns(_monthly(s, d)).where("ret is not null")
    dates = r.agg(F.count_distinct("date").alias("nd"))
    whole = r.groupBy("asset").agg(F.count("*").alias("n")).crossJoin(F.broadcast(dates)).where("n = nd")  # one row is crossed
    return portfolio.ewma_cov(r.join(whole, "asset", "left_semi"), 0.94)


QUERIES["ewma_cov"] = lambda s, d: _round(ewma_cov(s, d), 8)


@query("corr_distance_quantile", f", {_COV}, v as (select date, asset_i as k, cov as var from cov where asset_i = asset_j), x as (select c.date, sqrt(greatest(0, 0.5 * (1 - c.cov / sqrt(a.var * b.var)))) as dist from cov c join v a on a.date = c.date and a.k = asset_i join v b on b.date = c.date and b.k = asset_j where asset_i < asset_j) select date, round(quantile_cont(dist, 0.25), 6) as eps, round(avg(dist), 6) as mean_dist from x group by date")
def corr_distance_quantile(s, d):
    pairs = _correlated(_cov(s, d)).where("asset_i < asset_j")
    dist = F.sqrt(F.greatest(F.lit(0.0), 0.5 * (1 - F.col("corr"))))
    return pairs.withColumn("dist", dist).groupBy("date").agg(F.percentile("dist", F.lit(0.25)).alias("eps"), F.avg("dist").alias("mean_dist"))


_SCHED = "sched as (select * from (select distinct cast(date_trunc('month', date) + interval '1 month' - interval '1 day' as date) as rebalance_date from daily) where rebalance_date <= (select max(date) from daily))"


def _schedule(s, d):
    """Month ends up to the last date of the panel: an unfinished month has none."""
    days = P.daily(s, d).groupBy(F.last_day("date").alias("rebalance_date")).agg(F.max("date").alias("last"))
    return days.withColumn("last", F.max("last").over(Window.partitionBy())).where("rebalance_date <= last").select("rebalance_date")  # a row per month


@query("asof_trade_date", f", {_SCHED} select rebalance_date, (select max(date) from daily where date <= rebalance_date) as trade_date from sched")
def asof_trade_date(s, d):
    days = P.daily(s, d).select("date").distinct()
    spine = _schedule(s, d).select(F.col("rebalance_date").alias("at"), F.lit(None).cast("date").alias("date"), F.lit(True).alias("wanted")).unionByName(days.select(F.col("date").alias("at"), "date", F.lit(False).alias("wanted")))
    return spine.withColumn("trade_date", F.max("date").over(Window.orderBy("at"))).where("wanted").select(F.col("at").alias("rebalance_date"), "trade_date")


_CAND = f"{_SCHED}, asofs as (select rebalance_date, (select max(date) from daily where date <= rebalance_date) as date from sched), aged as (select *, row_number() over (partition by asset order by date) as age from daily), advs as (select date, asset, case when count(volume) over w = 2 then avg(volume) over w end as adv from dgrid window w as (partition by asset order by date rows between 1 preceding and current row)), cand as (select * from (select rebalance_date, g.asset, adv, row_number() over (partition by rebalance_date order by adv desc, g.asset) as rank from asofs a join aged g on g.date = a.date join advs v on v.date = g.date and v.asset = g.asset where g.close is not null and adv is not null and adv >= 20 and age >= 20) where rank <= 8)"


def _candidates(s, d):
    return portfolio.candidates(portfolio.snapshots(P.daily(s, d), _schedule(s, d), 2), top_n=8, adv_min=20, age_min=20)


@query("universe_topn", f", {_CAND} select rebalance_date, asset, round(adv, 6) as adv, cast(rank as integer) as rank from cand")
def universe_topn(s, d):
    return _candidates(s, d).select("rebalance_date", "asset", "adv", "rank")


@query("universe_hysteresis", f", {_CAND}, g as (select s.rebalance_date, a.asset, coalesce(cast(c.asset is not null as int), 0) as hit from sched s cross join (select distinct asset from cand) a left join cand c on c.rebalance_date = s.rebalance_date and c.asset = a.asset), e as (select *, case when count(*) over w = 2 and sum(hit) over w = 2 then 1 when count(*) over w = 2 and sum(hit) over w = 0 then 0 end as event from g window w as (partition by asset order by rebalance_date rows between 1 preceding and current row)), f as (select *, last_value(event ignore nulls) over (partition by asset order by rebalance_date rows between unbounded preceding and current row) as active from e) select rebalance_date, asset from f where active = 1")
def universe_hysteresis(s, d):
    return portfolio.universe(_candidates(s, d), _schedule(s, d), 2)


@query("anti_missing_assets", f", {_CAND} select s.rebalance_date, a.asset from sched s cross join (select distinct asset from cand) a where not exists (select 1 from cand c where c.rebalance_date = s.rebalance_date and c.asset = a.asset)")
def anti_missing_assets(s, d):
    c = _candidates(s, d)
    return _schedule(s, d).crossJoin(F.broadcast(c.select("asset").distinct())).join(c, ["rebalance_date", "asset"], "left_anti").select("rebalance_date", "asset")


@query("pairs_theta", "select a.asset as asset_i, b.asset as asset_j from (select distinct asset from monthly) a join (select distinct asset from monthly) b on a.asset < b.asset")
def pairs_theta(s, d):
    a = P.monthly(s, d).select("asset").distinct()
    return a.select(F.col("asset").alias("asset_i")).join(a.select(F.col("asset").alias("asset_j")), F.col("asset_i") < F.col("asset_j"))


@query("param_grid", "with a as (select unnest([30, 50, 70]) as win), b as (select unnest(['l1', 'l2']) as norm), c as (select unnest([6, 8, 10]) as cubes) select win, norm, cubes from a, b, c")
def param_grid(s, d):
    axis = lambda name, *values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    return s.range(1).select(axis("win", 30, 50, 70)).select("win", axis("norm", "l1", "l2")).select("win", "norm", axis("cubes", 6, 8, 10))


_EQ = "eq as (select date, 0.001 * avg(coalesce(ret, 0)) as ret from dpad group by date), curve as (select date, ret, exp(sum(ln(1 + ret)) over (order by date)) as equity from eq), dds as (select *, equity / max(equity) over (order by date rows between unbounded preceding and current row) - 1 as dd from curve)"


def equal_weight(s, d):
    """The equal-weight book of the daily panel at a thousandth of its exposure (brand prices are noisy): date, ret, equity, dd, and a constant asset."""
    by = Window.orderBy("date")  # one row per date
    book = factors.padded_returns(_daily(s, d)).groupBy("date").agg((0.001 * F.avg(F.coalesce("ret", F.lit(0.0)))).alias("ret")).withColumn("asset", F.lit("book"))
    return portfolio.drawdowns(book.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(by))))


@query("equity_curve", f", {_EQ} select date, round(ret, 6) as ret, round(equity, 4) as equity from curve")
def equity_curve(s, d):
    return equal_weight(s, d).select("date", "ret", F.round("equity", 4).alias("equity"))


@query("drawdown", f", {_EQ} select date, round(dd, 6) as dd from dds")
def drawdown(s, d):
    return equal_weight(s, d).select("date", "dd")


_KPI = "round(avg(ret) * 252 / (stddev_pop(ret) * sqrt(252)), 6) as sharpe, round(avg(ret) * 252 / (stddev_pop(case when ret < 0 then ret end) * sqrt(252)), 6) as sortino, round(pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1, 6) as cagr, round(stddev_pop(ret) * sqrt(252), 6) as vol, round(min(dd), 6) as mdd, round(cast(count(case when ret > 0 then 1 end) as double) / count(case when ret <> 0 then 1 end), 6) as hit_rate"


@query("kpis_basic", f", {_EQ} select 'book' as asset, {_KPI} from dds")
def kpis_basic(s, d):
    return portfolio.kpis(equal_weight(s, d), ["asset"])


def _windowed(key: str, source: str) -> str:
    """Growth and peak of each window for itself."""
    return f"wc as (select {key} as w, date, ret, exp(sum(ln(1 + ret)) over (partition by {key} order by date)) as equity from {source}), wd as (select *, equity / max(equity) over (partition by w order by date rows between unbounded preceding and current row) - 1 as dd from wc)"


@query("kpis_by_year", f", {_EQ}, {_windowed('year(date)', 'eq')} select cast(w as integer) as year, {_KPI} from wd group by 1")
def kpis_by_year(s, d):
    own = equal_weight(s, d).select("date", "ret", F.year("date").alias("year"))
    return portfolio.kpis(portfolio.window_curves(own, ["year"]), ["year"])


@query("time_under_water", ", c as (select date, asset, p as equity from mfill where p is not null), f as (select *, cast(equity / max(equity) over (partition by asset order by date rows between unbounded preceding and current row) - 1 < -1e-12 as int) as under from c), i as (select *, sum(1 - under) over (partition by asset order by date) as island from f), m as (select *, max(island) over (partition by asset) as newest from i), sp as (select asset, island, count(*) as n from m where under = 1 and island < newest group by 1, 2) select a.asset, round(coalesce(avg(n), 0), 6) as avg_tuw, cast(coalesce(max(n), 0) as bigint) as max_tuw from (select distinct asset from c) a left join sp on sp.asset = a.asset group by 1")
def time_under_water(s, d):
    return portfolio.underwater(_monthly(s, d).select("date", "asset", filled(F.col("close")).alias("equity")).where("equity is not null"))


@query("relative_kpis", f", {_EQ}, b as (select date, ret as br from dpad where asset = (select min(asset) from daily)), j as (select c.ret, br from curve c join b on b.date = c.date where br is not null) select round(covar_samp(ret, br) / var_pop(br), 6) as beta, round(corr(ret, br), 6) as corr, round(stddev_pop(ret - br) * sqrt(252), 6) as tracking_error, round((avg(ret) - covar_samp(ret, br) / var_pop(br) * avg(br)) * 252, 6) as alpha from j")
def relative_kpis(s, d):
    r = factors.padded_returns(_daily(s, d))
    b = r.join(F.broadcast(r.agg(F.min("asset").alias("asset"))), "asset").where("ret is not null").select("date", F.col("ret").alias("br"))
    j = equal_weight(s, d).select("date", "ret").join(b, "date")
    beta = F.covar_samp("ret", "br") / F.var_pop("br")
    return j.agg(beta.alias("beta"), F.corr("ret", "br").alias("corr"), (F.stddev_pop(F.col("ret") - F.col("br")) * F.sqrt(F.lit(252.0))).alias("tracking_error"), ((F.avg("ret") - beta * F.avg("br")) * 252).alias("alpha"))


@query("rolling_windows", "with n as (select count(*) as n from (select distinct cast(l_shipdate as date) from lineitem)) select cast(i as bigint) as window_id, i * 126 as is_start, i * 126 + 503 as is_end, i * 126 + 504 as oos_start, i * 126 + 629 as oos_end from n, range(0, 1000) r(i) where i * 126 + 630 <= n")
def rolling_windows(s, d):
    n = P.table(s, d, "lineitem").agg(F.count_distinct(F.to_date("l_shipdate")).alias("n"))
    w = n.select(F.explode(F.expr("case when n >= 630 then sequence(0L, (n - 630) div 126) else array() end")).alias("window_id"))
    i = F.col("window_id") * 126
    return w.select("window_id", i.alias("is_start"), (i + 503).alias("is_end"), (i + 504).alias("oos_start"), (i + 629).alias("oos_end"))


@query("purged_folds", ", c as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from monthly)), f as (select *, case when i < (n % 5) * (n // 5 + 1) then i // (n // 5 + 1) else (i - (n % 5) * (n // 5 + 1)) // (n // 5) + n % 5 end as fold from c), b as (select fold, min(i) as lo, max(i) as hi, count(*) as test from f group by fold) select cast(b.fold as bigint) as fold, count(*) filter (where i < lo - 2 or i > hi + 2) as train, any_value(test) as test from b, f group by b.fold")
def purged_folds(s, d):
    by = Window.orderBy("date")
    c = P.monthly(s, d).select("date").distinct().withColumn("i", (F.row_number().over(by) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy()))
    f = c.withColumn("fold", F.expr("case when i < (n % 5) * (n div 5 + 1) then i div (n div 5 + 1) else (i - (n % 5) * (n div 5 + 1)) div (n div 5) + n % 5 end"))
    b = f.groupBy("fold").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("test"))
    return f.select("i").join(F.broadcast(b)).groupBy("fold").agg(F.count_if((F.col("i") < F.col("lo") - 2) | (F.col("i") > F.col("hi") + 2)).alias("train"), F.first("test").alias("test"))


_OOS = "n as (select *, row_number() over (order by date) - 1 as i from eq), oos as (select *, (i - 504) // 126 as win from n where i >= 504 and i < 504 + 126 * ((select count(*) - 504 from eq) // 126))"


def _out_of_sample(s, d) -> DataFrame:
    numbered = equal_weight(s, d).withColumn("i", (F.row_number().over(Window.orderBy("date")) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.where(F.expr("i >= 504 and i < 504 + 126 * ((n - 504) div 126)")).select("date", "ret", F.expr("(i - 504) div 126").alias("window_id"))


@query("walkforward_kpis", f", {_EQ}, {_OOS}, {_windowed('win', 'oos')} select cast(w as bigint) as window_id, {_KPI} from wd group by 1")
def walkforward_kpis(s, d):
    return portfolio.kpis(portfolio.window_curves(_out_of_sample(s, d), ["window_id"]), ["window_id"])


@query("walkforward_combined", f", {_EQ}, {_OOS}, {_windowed('1', 'oos')} select {_KPI}, round((pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1) / nullif(abs(min(dd)), 0), 4) as calmar, count(*) as days from wd")
def walkforward_combined(s, d):
    """All out-of-sample days as one curve."""
    own = portfolio.window_curves(_out_of_sample(s, d).withColumn("all", F.lit(1)), ["all"])
    k = portfolio.kpis(own, ["all"]).withColumn("calmar", F.round(F.try_divide("cagr", F.nullif(F.abs("mdd"), F.lit(0.0))), 4)).drop("all")
    return k.crossJoin(own.agg(F.count("*").alias("days")))  # one row each


@query("tercile_kpis", f", {_EQ}, {_REG}, m as (select cast(date_trunc('month', date) as date) as mo, ret from eq), j as (select z, ret from m join regime r on r.date = m.mo where z is not null), q as (select quantile_cont(z, 1.0 / 3) as a, quantile_cont(z, 2.0 / 3) as b from j) select case when z <= a then 'low' when z <= b then 'mid' else 'high' end as tercile, count(*) as days, round(avg(ret) * 252, 6) as ann_return, round(stddev_pop(ret) * sqrt(252), 6) as vol from j, q group by 1")
def tercile_kpis(s, d):
    r = F.broadcast(regime_frame(s, d).where("z is not null").select(F.col("date").alias("mo"), "z"))
    j = equal_weight(s, d).select(F.to_date(F.trunc("date", "month")).alias("mo"), "ret").join(r, "mo")
    q = j.agg(F.percentile("z", F.lit(1.0 / 3)).alias("a"), F.percentile("z", F.lit(2.0 / 3)).alias("b"))
    t = F.when(F.col("z") <= F.col("a"), "low").when(F.col("z") <= F.col("b"), "mid").otherwise("high")
    return j.crossJoin(F.broadcast(q)).groupBy(t.alias("tercile")).agg(F.count("*").alias("days"), (F.avg("ret") * 252).alias("ann_return"), (F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("vol"))


@query("threshold_filter", f", {_REG} select r.date, round(case when z <= 0.5 then m else 0 end, 6) as ret from regime r join market k on k.date = r.date where z is not null")
def threshold_filter(s, d):
    market = factors.padded_returns(_monthly(s, d)).groupBy("date").agg(F.avg("ret").alias("m"))
    return regime_frame(s, d).where("z is not null").join(market, "date").select("date", F.when(F.col("z") <= 0.5, F.col("m")).otherwise(0.0).alias("ret"))


@query("psr_moments", f", {_EQ}, x as (select ret, avg(ret) over () as m, stddev_pop(ret) over () as sd from eq) select count(*) as n, round(avg(pow((ret - m) / sd, 3)), 4) as skew, round(avg(pow((ret - m) / sd, 4)), 4) as kurt from x")
def psr_moments(s, d):
    return equal_weight(s, d).agg(F.count("*").alias("n"), F.round(F.skewness("ret"), 4).alias("skew"), F.round(F.kurtosis("ret") + 3, 4).alias("kurt"))


@query("mean_ic", f", {_MOM}, f as (select date, asset, lead(close, 1) over (partition by asset order by date) / close - 1 as fwd from mgrid), j as (select m.date, corr(momentum, fwd) as ic from mmom m join f on f.date = m.date and f.asset = m.asset where momentum is not null and fwd is not null group by m.date having count(*) >= 3) select round(avg(ic), 6) as mean_ic, count(ic) as n from j")
def mean_ic(s, d):
    g = _monthly(s, d)
    j = factors.momentum(g, 12, 1).join(factors.forward_returns(g, 1), ["date", "asset"]).where("momentum is not null and fwd is not null")
    ic = j.groupBy("date").agg(F.corr("momentum", "fwd").alias("ic"), F.count("*").alias("k")).where("k >= 3")
    return ic.agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n"))


@query("ridge_normal_eq", f", {_MOM}, {_QUAL}, f as (select date, asset, lead(close, 1) over (partition by asset order by date) / close - 1 as y from mgrid), j as (select momentum as a, quality as b, y from mmom m join mqual q on q.date = m.date and q.asset = m.asset join f on f.date = m.date and f.asset = m.asset where momentum is not null and quality is not null and y is not null), c as (select count(*) * var_pop(a) + 0.1 as aa, count(*) * var_pop(b) + 0.1 as bb, count(*) * covar_pop(a, b) as ab, count(*) * covar_pop(a, y) as ay, count(*) * covar_pop(b, y) as by_ from j) select round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) as w_momentum, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) as w_quality from c")
def ridge_normal_eq(s, d):
    g = _monthly(s, d)
    j = factors.momentum(g, 12, 1).join(factors.quality(g, 6, 12), ["date", "asset"]).join(factors.forward_returns(g, 1), ["date", "asset"]).where("momentum is not null and quality is not null and fwd is not null")
    n = F.count("*")
    c = j.agg((n * F.var_pop("momentum") + 0.1).alias("aa"), (n * F.var_pop("quality") + 0.1).alias("bb"), (n * F.covar_pop("momentum", "quality")).alias("ab"), (n * F.covar_pop("momentum", "fwd")).alias("ay"), (n * F.covar_pop("quality", "fwd")).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return c.select(((F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det).alias("w_momentum"), ((F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det).alias("w_quality"))


@query("gini_sizes", "with s as (select label, count(*) as n from embeddings group by label), o as (select n, row_number() over (order by n, label) as i, count(*) over () as k, sum(n) over () as t from s) select round(least(greatest(2.0 * sum(i * n) / (any_value(k) * any_value(t)) - (any_value(k) + 1.0) / any_value(k), 0), 1), 6) as gini from o")
def gini_sizes(s, d):
    n = P.table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    o = n.withColumn("i", F.row_number().over(Window.orderBy("n", "label")))
    k, t = F.count("*"), F.sum("n")
    return o.agg(F.least(F.greatest(2.0 * F.sum(F.col("i") * F.col("n")) / (k * t) - (k + 1) / k, F.lit(0.0)), F.lit(1.0)).alias("gini"))


_EDGE = f"{_COV}, v as (select date, asset_i as k, cov as var from cov where asset_i = asset_j), near as (select c.date, asset_i, asset_j from cov c join v a on a.date = c.date and a.k = asset_i join v b on b.date = c.date and b.k = asset_j where asset_i <> asset_j and c.cov / sqrt(a.var * b.var) > 0.3)"


def _correlated(cov):
    """Covariances with ``corr``: variances come from windows over the same rows, so the covariances are made once."""
    variance = lambda k: F.max(F.when(F.col("asset_i") == F.col("asset_j"), F.col("cov"))).over(Window.partitionBy("date", k))
    return cov.withColumn("corr", F.col("cov") / F.sqrt(variance("asset_i") * variance("asset_j")))


@query("node_degree", f", {_EDGE} select v.date, v.k as asset, round(coalesce(cast(n as double), 0) / nullif(count(*) over (partition by v.date) - 1, 0), 6) as degree from v left join (select date, asset_i, count(*) as n from near group by 1, 2) e on e.date = v.date and e.asset_i = v.k")
def node_degree(s, d):
    n = _correlated(_cov(s, d)).groupBy("date", F.col("asset_i").alias("asset")).agg(F.count_if((F.col("asset_i") != F.col("asset_j")) & (F.col("corr") > 0.3)).alias("n"))
    return n.select("date", "asset", F.try_divide(F.col("n").cast("double"), F.count("*").over(by_date()) - 1).alias("degree"))


@query("components", f", {_EDGE} select date, asset, min(root) as component from (with recursive r(date, asset, root) as (select date, k, k from v union select r.date, n.asset_j, r.root from r join near n on n.date = r.date and n.asset_i = r.asset) select * from r) group by 1, 2")
def components(s, d):
    edges = _correlated(_cov(s, d)).where("asset_i = asset_j or corr > 0.3").select("date", "asset_i", "asset_j")
    return edges.groupBy("date").applyInPandas(graphs.components_of, "date date, asset string, component string")  # a group holds one date's assets


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]  # all of the generated part table


@query("pivot_matrix", "select date, " + ", ".join(f"round(sum(case when asset = '{b}' then close end), 9) as \"{b}\"" for b in _BRANDS) + " from monthly group by date", digits=9)  # at six, one value of sf0.001 is a tie
def pivot_matrix(s, d):
    """A column for each brand of the part table."""
    brands = [r[0] for r in P.table(s, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    return P.monthly(s, d).groupBy("date").pivot("asset", brands).agg(F.sum("close"))


@query("unpivot_features", "select date, asset, 'close' as feature, round(close, 6) as value from monthly union all select date, asset, 'volume', round(volume, 6) from monthly")
def unpivot_features(s, d):
    return P.monthly(s, d).unpivot(["date", "asset"], ["close", "volume"], "feature", "value")


@query("counts_ordered", "select event_type, count(*) as n, cast(row_number() over (order by count(*) desc, event_type) as integer) as place from events group by event_type")
def counts_ordered(s, d):
    return P.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))


@query("best_per_stage", "select c_mktsegment as stage, c_custkey as best, round(c_acctbal, 6) as score from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as i from customer) where i = 1")
def best_per_stage(s, d):
    best = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return P.table(s, d, "customer").withColumn("i", F.row_number().over(best)).where("i = 1").select(F.col("c_mktsegment").alias("stage"), F.col("c_custkey").alias("best"), F.col("c_acctbal").alias("score"))


@query("quality_profile", "select count(*) as n_rows, count(distinct date) as n_days, count(distinct asset) as n_assets, round(100.0 * count(*) filter (where close is null) / count(*), 6) as pct_null_close, round(100.0 * count(*) filter (where volume = 0) / count(*), 6) as pct_zero_volume from dgrid")
def quality_profile(s, d):
    n = F.count("*")
    return _daily(s, d).agg(n.alias("n_rows"), F.count_distinct("date").alias("n_days"), F.count_distinct("asset").alias("n_assets"), (100.0 * F.count_if(F.col("close").isNull()) / n).alias("pct_null_close"), (100.0 * F.count_if(F.col("volume") == 0) / n).alias("pct_zero_volume"))


@query("trade_costs", f", {_ATR}, t as (select date, asset, 1e6 * (coalesce(weight, 0) - coalesce(lag(weight) over (partition by asset order by date), 0)) as notional from invw), j as (select t.date, t.asset, notional, m.close * m.volume as adv from t join monthly m on m.date = t.date and m.asset = t.asset where abs(notional) > 1e-3) select date, asset, round(abs(notional) * 5 / 1e4, 4) as fees, round(abs(notional) * least(50, 0.1 * 1e4 * abs(notional) / adv) / 1e4, 4) as slip from j")
def trade_costs(s, d):
    t = _inverse(s, d).select("date", "asset", (1e6 * (F.coalesce("weight", F.lit(0.0)) - F.coalesce(F.lag("weight").over(by_time()), F.lit(0.0)))).alias("notional"))
    j = t.join(P.monthly(s, d).select("date", "asset", (F.col("close") * F.col("volume")).alias("adv")), ["date", "asset"]).where("abs(notional) > 1e-3")
    return portfolio.costs(j).select("date", "asset", F.round("fees", 4).alias("fees"), F.round("slip", 4).alias("slip"))


@query("kill_flags", f", {_EQ}, k as (select date, dd, stddev_pop(ret) over w * sqrt(252) as vol, count(*) over w as n from dds window w as (order by date rows between 59 preceding and current row)) select date, dd <= -0.15 as mdd_hit, coalesce(case when n = 60 then vol end > 0.18, false) as vol_hit from k")
def kill_flags(s, d):
    by = Window.orderBy("date")
    vol = rolling(F.stddev_pop, F.col("ret"), 60, window=by) * F.sqrt(F.lit(252.0))
    return equal_weight(s, d).select("date", (F.col("dd") <= -0.15).alias("mdd_hit"), F.coalesce(vol > 0.18, F.lit(False)).alias("vol_hit"))


@query("cooldown_ok", f", {_REG} select date, count(*) over w = 3 and max(regime) over w < 0.5 as ok from regime window w as (order by date rows between 2 preceding and current row)")
def cooldown_ok(s, d):
    w = Window.orderBy("date").rowsBetween(-2, 0)
    return regime_frame(s, d).select("date", ((F.count("*").over(w) == 3) & (F.max("regime").over(w) < 0.5)).alias("ok"))


@query("regime_controls", f", {_REG} select date, round(0.12 * (0.8 + 0.4 * regime), 6) as target_vol, round(least(1, 1 - 0.2 * regime), 6) as gross, round(0.0193 + (0.05 - 0.0193) * regime, 6) as asset_cap from regime")
def regime_controls(s, d):
    r = F.col("regime")
    return regime_frame(s, d).select("date", (0.12 * (0.8 + 0.4 * r)).alias("target_vol"), F.least(F.lit(1.0), 1 - 0.2 * r).alias("gross"), (0.0193 + (0.05 - 0.0193) * r).alias("asset_cap"))


@query("vol_scaled_weights", f", {_COV}, q as (select date, sum(cov) / pow(count(distinct asset_i), 2) as var, count(distinct asset_i) as n from cov group by date) select date, round(1.0 / n * 0.12 / (sqrt(var) * sqrt(12)), 6) as weight, n as assets from q")
def vol_scaled_weights(s, d):
    q = _cov(s, d).groupBy("date").agg(F.sum("cov").alias("total"), F.count_distinct("asset_i").alias("assets"))
    n = F.col("assets")
    return q.select("date", (1.0 / n * 0.12 / (F.sqrt(F.col("total") / F.pow(n, F.lit(2.0))) * F.sqrt(F.lit(12.0)))).alias("weight"), "assets")


@query("asof_cov", f", {_COV} select m.date, (select max(c.date) from cov c where c.date <= m.date) as cov_date from (select distinct date from monthly) m")
def asof_cov(s, d):
    have = _cov(s, d).select("date").distinct().withColumn("cov_date", F.col("date"))
    dates = P.monthly(s, d).select("date").distinct().join(have, "date", "left")
    return dates.select("date", F.last("cov_date", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("cov_date"))


@query("interval_windows", f", {_ENDS}, w as (select de, te from ends) select w.de as window_end, count(*) as n_rows, round(sum(m.volume), 6) as volume from w join monthly m on m.date <= w.de and m.date > w.de - interval '365 days' group by 1")
def interval_windows(s, d):
    g = _monthly(s, d)
    last = g.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date"))).where(EVERY_MONTH).select(F.col("date").alias("window_end"))
    j = P.monthly(s, d).join(F.broadcast(last), (F.col("date") <= F.col("window_end")) & (F.col("date") > F.date_sub("window_end", 365)))
    return j.groupBy("window_end").agg(F.count("*").alias("n_rows"), F.sum("volume").alias("volume"))


@query("risk_free_aligned", "with e as (select cast(ts as date) as date, avg(value) as v from events where event_type = 'purchase' group by 1), c as (select unnest(generate_series((select min(date) from e), (select max(date) from e), interval 1 day))::date as date), j as (select c.date, v from c left join e on e.date = c.date where isodow(c.date) <= 5) select date, round(coalesce(last_value(v ignore nulls) over (order by date rows between unbounded preceding and current row), first_value(v ignore nulls) over (order by date rows between current row and unbounded following), 0), 4) as rate from j")
def risk_free_aligned(s, d):
    """All observed rates on the business days between the first and the last of them. As in a reindex, a weekend's rate fills no later day."""
    e = P.table(s, d, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    days = e.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date")).where(F.dayofweek("date").between(2, 6))
    by = Window.orderBy("date")
    j = days.join(e, "date", "left")
    return j.select("date", F.round(F.coalesce(filled(F.col("v"), by), back_filled(F.col("v"), by), F.lit(0.0)), 4).alias("rate"))


@query("benchmark_rebased", "with p as (select cast(o_orderdate as date) as date, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v from orders group by 1) select date, round(v / first_value(v) over (order by date), 6) as rebased from p")
def benchmark_rebased(s, d):
    p = P.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return p.select("date", (F.col("v") / F.first("v").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).alias("rebased"))


@query("hash_md5", "select n_nationkey, md5(concat_ws('|', cast(n_nationkey as varchar), n_name)) as h from nation")
def hash_md5(s, d):
    return P.table(s, d, "nation").select("n_nationkey", F.md5(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name")).alias("h"))


@query("category_codes", "select p_type, cast(dense_rank() over (order by p_type) - 1 as bigint) as code from (select distinct p_type from part)")
def category_codes(s, d):
    return P.table(s, d, "part").select("p_type").distinct().select("p_type", (F.dense_rank().over(Window.orderBy("p_type")) - 1).cast("long").alias("code"))


@query(
    "psr_zscore",
    f""", {_EQ}, a as (select count(*) as n, avg(ret) as m, stddev_pop(ret) as d from curve),
b as (select n, m / d * sqrt(252.0) as sr, avg(power((ret - m) / d, 3)) as sk, avg(power((ret - m) / d, 4)) as ku from curve cross join a group by n, m, d)
select n, round(sr, 4) as sharpe, round(sr * sqrt(n - 1.0) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr), 4) as z from b""",
)
def psr_zscore(s, d):
    m = equal_weight(s, d).agg(F.count("*").alias("n"), (F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("sr"), F.skewness("ret").alias("sk"), (F.kurtosis("ret") + 3).alias("ku"))
    z = F.col("sr") * F.sqrt(F.col("n") - 1.0) / F.sqrt(1 - F.col("sk") * F.col("sr") + (F.col("ku") - 1) / 4 * F.col("sr") * F.col("sr"))
    return m.select("n", F.round("sr", 4).alias("sharpe"), F.round(z, 4).alias("z"))


@query("stream_daily_events", "select cast(ts as date) as date, event_type, count(*) as n, round(cast(sum(cast(value as decimal(18,6))) as double), 6) as total from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by 1, 2")
def stream_daily_events(s, d):
    return windows.drained(s, f"{d}/events.parquet", windows.daily_counts)


@query("stream_user_sessions", "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as spell from e), g as (select user_id, min(ts) as a, max(ts) + interval 30 minute as b, count(*) as n from s group by user_id, spell) select user_id, cast(epoch_us(a) as bigint) as started, n from g where b <= (select max(ts) from events) - interval 1 hour")
def stream_user_sessions(s, d):
    return windows.drained(s, f"{d}/events.parquet", windows.user_sessions)


@query("stream_first_sightings", "select event_type, count(*) as n from events group by 1")
def stream_first_sightings(s, d):
    return windows.drained(s, f"{d}/events.parquet", windows.first_sightings).groupBy("event_type").agg(F.count("*").alias("n"))


# ---- kernels without SQL: resamples of one series, or one date's assets


@query("perm_pvalue")
def perm_pvalue(s, d):
    return resampling.permutation_pvalues(equal_weight(s, d).select("asset", "date", "ret"), trials=9)


@query("bootstrap_ci")
def bootstrap_ci(s, d):
    return resampling.bootstrap_intervals(equal_weight(s, d).select("asset", "date", "ret"))


# an edge belongs to the tree if no path of smaller edges joins its ends: five squarings of the least largest edge reach 32 steps
_TREE = f"{_COV}, v as (select date, asset_i as k, cov as var from cov where asset_i = asset_j), b0 as (select c.date, asset_i as i, asset_j as j, sqrt(greatest(0, 0.5 * (1 - c.cov / sqrt(a.var * b.var)))) as d from cov c join v a on a.date = c.date and a.k = asset_i join v b on b.date = c.date and b.k = asset_j)" + "".join(f", b{k} as (select x.date, x.i, y.j, min(greatest(x.d, y.d)) as d from b{k - 1} x join b{k - 1} y on x.date = y.date and x.j = y.i group by 1, 2, 3)" for k in range(1, 6))


@query("mst_edges", f", {_TREE} select e.date, e.i as src, e.j as dst, round(e.d, 6) as weight from b0 e join b5 on b5.date = e.date and b5.i = e.i and b5.j = e.j where e.i < e.j and e.d <= b5.d")
def mst_edges(s, d):
    """The edges of each month's tree, ends in order of name."""
    edges = _cov(s, d).groupBy("date").applyInPandas(graphs.spanning_tree, "date date, src string, dst string, weight double")
    return edges.select("date", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")


@query("hrp_weights")
def hrp_weights(s, d):
    return _cov(s, d).groupBy("date").applyInPandas(graphs.hierarchical_weights, "date date, asset string, weight double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["momentum_top5"](spark, sf_dir)
