"""Registered walk-forward blends of factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridax.operators import blend, factors
from meridax.plans.queries import _MOM, _QUAL, _Z, _monthly, query

GRID = [{"penalty": 1.0}, {"penalty": 10.0}, {"penalty": 1.0, "mixing": 0.5}]


def features(s, d):
    """(date, asset, momentum, quality, slope, momentum_x_quality, target) by month; the target is the next month's return."""
    g = _monthly(s, d)
    parts = factors.momentum(g, 12, 1).join(factors.quality(g, 6, 12), ["date", "asset"]).join(factors.slope(g, 6), ["date", "asset"])
    return blend.interactions(parts, [("momentum", "quality")]).join(factors.forward_returns(g, 1).withColumnRenamed("fwd", "target"), ["date", "asset"])


_FEATURES = f""", {_MOM}, {_QUAL}, sn as (select date, asset, ln(close) as y, row_number() over (partition by asset order by date) as x from mgrid),
sf as (select date, asset, case when count(y) over w = 6 then regr_slope(y, x) over w end as raw from sn window w as (partition by asset order by date rows between 5 preceding and current row)),
sz as (select date, asset, {_Z.format(x='raw')} as slope from sf),
fw as (select date, asset, lead(close, 1) over (partition by asset order by date) / close - 1 as target from mgrid)
select m.date, m.asset, round(momentum, 6) as momentum, round(quality, 6) as quality, round(slope, 6) as slope, round(momentum * quality, 6) as momentum_x_quality, round(target, 6) as target
from mmom m join mqual q on q.date = m.date and q.asset = m.asset join sz on sz.date = m.date and sz.asset = m.asset join fw on fw.date = m.date and fw.asset = m.asset"""


@query("blend_features", _FEATURES)
def blend_features(s, d):
    return features(s, d)


@query("blend_scores")
def blend_scores(s, d):
    return blend.walk(features(s, d), ["momentum", "quality", "slope", "momentum_x_quality"], grid=GRID)


@query("blend_ic")
def blend_ic(s, d):
    """The information coefficient of the blend's scores, by year."""
    scored = blend.walk(features(s, d), ["momentum", "quality", "slope", "momentum_x_quality"], grid=GRID)
    known = scored.join(features(s, d).select("date", "asset", "target"), ["date", "asset"]).where("target is not null")
    ic = known.groupBy("date").agg(F.corr("score", "target").alias("ic"), F.count("*").alias("k")).where("k >= 3")
    return ic.groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("months"))
