"""Registered queries on topology and shrinkage: kernels per window, most without SQL; the tests hold them against plain code."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridax.operators import factors, topology
from meridax.plans.queries import _monthly, query, regime_frame

WINDOW = 12  # months


def _returns(s, d):
    return factors.padded_returns(_monthly(s, d)).where("ret is not null")


@query("ph_diagrams")
def ph_diagrams(s, d):
    return topology.diagrams(_returns(s, d), WINDOW)


@query("ph_turbulence")
def ph_turbulence(s, d):
    """The norm of each window's landscape with counts, lengths, entropy and the shift from the window before."""
    found = topology.diagrams(_returns(s, d), WINDOW).persist()  # a few dozen rows per window, read by five branches
    return topology.turbulence(found).join(topology.summaries(found), "date").join(topology.shifts(found), "date", "left")


@query("ph_regime")
def ph_regime(s, d):
    """The regime from persistence: z-scores of the smoothed turbulence over 12 windows, scaled between two thresholds."""
    from pyspark.sql import Window

    from meridax.functions.series import clamp, ewm

    by = Window.orderBy("date")  # a row per month
    smooth = topology.turbulence(topology.diagrams(_returns(s, d), WINDOW)).select("date", ewm(F.col("turbulence"), 3, by).alias("e"))
    frame = by.rowsBetween(-11, 0)
    spread = F.stddev_pop("e").over(frame)
    z = smooth.select("date", F.when((F.count("e").over(frame) == 12) & (spread > 0), (F.col("e") - F.avg("e").over(frame)) / spread).alias("zscore"))
    return z.select("date", "zscore", F.coalesce(clamp((F.col("zscore") - 0.58) / 1.22, 0.0, 1.0), F.lit(0.0)).alias("regime"), F.coalesce(F.col("zscore") >= 0.58, F.lit(False)).alias("is_alert"), F.coalesce(F.col("zscore") >= 1.8, F.lit(False)).alias("is_riskoff"))


def _nodes(s, d, lens: str):
    regime = F.broadcast(regime_frame(s, d).select("date", "regime"))  # a row per month
    return topology.mapper_nodes(_returns(s, d).join(regime, "date", "left"), WINDOW, lens=lens, cubes=6)


for _lens in ("volatility", "sharpe", "pca"):

    @query(f"mapper_nodes_{_lens}")
    def _mapper(s, d, lens=_lens):
        return _nodes(s, d, lens)


@query("asset_centrality")
def asset_centrality(s, d):
    return topology.asset_centrality(_nodes(s, d, "volatility"))


@query("peripherality")
def peripherality(s, d):
    return topology.peripherality(topology.asset_centrality(_nodes(s, d, "volatility")))


@query("mapper_json")
def mapper_json(s, d):
    return topology.graph_json(_nodes(s, d, "volatility"))


@query("mix_periphery")
def mix_periphery(s, d):
    """The mix with the periphery term; assets that no node holds count 0."""
    from meridax.plans.queries import _scores

    own = topology.peripherality(topology.asset_centrality(_nodes(s, d, "volatility")))
    return factors.mix(_scores(s, d).join(own, ["date", "asset"], "left"), delta=0.4)


_LW = """, lt as (select date, row_number() over (order by date) as t from (select distinct date from mpad where ret is not null)),
ls as (select e.date as de, m.asset, m.ret, m.date from lt e join lt s on s.t <= e.t and s.t > e.t - 12 join mpad m on m.date = s.date where e.t >= 12 and m.ret is not null),
lf as (select *, ret - avg(ret) over (partition by de, asset) as x from ls qualify count(*) over (partition by de, asset) = 12),
lc as (select a.de as date, a.asset as asset_i, b.asset as asset_j, avg(a.x * b.x) as cov, avg(a.x * a.x * b.x * b.x) as quad from lf a join lf b on a.de = b.de and a.date = b.date group by 1, 2, 3),
lm as (select date, count(distinct asset_i) as p, sum(case when asset_i = asset_j then cov end) / count(distinct asset_i) as mean, sum(cov * cov) as sq, sum(quad) as quad from lc group by 1),
lh as (select date, mean, least((sq - p * mean * mean) / p, (quad - sq) / 12 / p) / ((sq - p * mean * mean) / p) as share from lm)
select c.date, asset_i, asset_j, round((1 - share) * cov + case when asset_i = asset_j then share * mean else 0 end, 8) as cov, round(share, 8) as shrinkage from lc c join lh on lh.date = c.date"""


@query("ledoit_wolf", _LW, digits=8)
def ledoit_wolf(s, d):
    return topology.ledoit_wolf_pairs(_returns(s, d), WINDOW)
