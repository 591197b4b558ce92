"""Registered relational basics: joins, sets, sorts, arrays, maps and JSON over the same tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridax.functions.series import erf
from meridax.operators import factors, portfolio
from meridax.plans.queries import _EQ, _MOM, _QUAL, _REG, _EDGE, _daily, _monthly, equal_weight, query, regime_frame
from meridax.sources import panel as P


def _events(s, d, kind: str, name: str) -> DataFrame:
    return P.table(s, d, "events").where(F.col("event_type") == kind).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias(name))


@query("full_outer_days", "select date, coalesce(p, 0) as purchases, coalesce(e, 0) as errors from (select cast(ts as date) as date, count(*) as p from events where event_type = 'purchase' group by 1) full outer join (select cast(ts as date) as date, count(*) as e from events where event_type = 'error' and value > 20 group by 1) using (date)")
def full_outer_days(s, d):
    errors = P.table(s, d, "events").where("event_type = 'error' and value > 20").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("errors"))
    both = _events(s, d, "purchase", "purchases").join(errors, "date", "full_outer")
    return both.select("date", F.coalesce("purchases", F.lit(0)).alias("purchases"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query("asof_atr", ", atrs as (select date, asset, case when count(ret) over w = 6 then avg(abs(ret)) over w end as atr from mpad window w as (partition by asset order by date rows between 5 preceding and current row)), days as (select distinct cast(o_orderdate as date) as day from orders), a as (select date, asset, atr from atrs where atr is not null) select day, asset, round(arg_max(atr, date), 6) as atr from days join a on a.date <= day group by 1, 2")
def asof_atr(s, d):
    """For each order day the last known average range of each asset: a union in time order and one window per asset, no range join."""
    known = factors.atr(_monthly(s, d), 6).where("atr is not null")
    days = P.table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    asked = days.join(F.broadcast(known.select("asset").distinct())).select(F.col("day").alias("at"), "asset", F.lit(None).cast("double").alias("atr"), F.lit(1).alias("turn"))
    line = known.select(F.col("date").alias("at"), "asset", "atr", F.lit(0).alias("turn")).unionByName(asked)
    last = F.last("atr", ignorenulls=True).over(Window.partitionBy("asset").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("atr", last).where("turn = 1 and atr is not null").select(F.col("at").alias("day"), "asset", "atr")


@query("members_join", f", {_EDGE}, c as (select date, asset, min(root) as component from (with recursive r(date, asset, root) as (select date, k, k from v union select r.date, n.asset_j, r.root from r join near n on n.date = r.date and n.asset_i = r.asset) select * from r) group by 1, 2), nodes as (select date, component, list(asset order by asset) as members from c group by 1, 2) select n.date, component, len(members) as size, round(avg(m.close), 6) as mean_close from nodes n join monthly m on m.date = n.date and list_contains(members, m.asset) group by 1, 2, 3")
def members_join(s, d):
    """Nodes with arrays of members, joined to the panel by membership: exploded to an equi-join."""
    from meridax.plans.queries import components

    nodes = components(s, d).groupBy("date", "component").agg(F.sort_array(F.collect_list("asset")).alias("members"))
    rows = nodes.select("date", "component", F.size("members").cast("long").alias("size"), F.explode("members").alias("asset"))
    return rows.join(P.monthly(s, d), ["date", "asset"]).groupBy("date", "component", "size").agg(F.avg("close").alias("mean_close"))


@query("multi_key_sort", "select c_nationkey, c_custkey, cast(row_number() over (partition by c_nationkey order by c_mktsegment, c_acctbal desc, c_custkey) as integer) as place from customer")
def multi_key_sort(s, d):
    by = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")
    return P.table(s, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(by).alias("place"))


@query("grid_limit", "with a as (select unnest([30, 50, 70]) as win), b as (select unnest(['l1', 'l2']) as norm), c as (select unnest([6, 8, 10]) as cubes) select win, norm, cubes from a, b, c order by win, norm, cubes limit 5")
def grid_limit(s, d):
    """The first runs of a parameter grid: the limit is the feature."""
    from meridax.plans.queries import param_grid

    return param_grid(s, d).orderBy("win", "norm", "cubes").limit(5)


@query("frame_stride", "select date, cast((t - 1) // 3 as bigint) as frame, (t - 1) % 3 = 0 as shown from (select date, row_number() over (order by date) as t from (select distinct date from monthly))")
def frame_stride(s, d):
    """Which months an animation of every third month shows, and in which frame each falls."""
    t = F.row_number().over(Window.orderBy("date")) - 1
    return P.monthly(s, d).select("date").distinct().select("date", F.floor(t / 3).cast("long").alias("frame"), (t % 3 == 0).alias("shown"))


@query("dates_in_order", "select date, row_number() over (order by date) as place from (select distinct date from daily)")
def dates_in_order(s, d):
    return P.daily(s, d).select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).cast("long").alias("place"))


_HELD = "held as (select date, list(asset order by asset) as assets from (select date, asset, row_number() over (partition by date order by volume desc, asset) as r from monthly) where r <= 8 group by 1), moved as (select date, assets, lag(assets) over (order by date) as before from held)"


@query("set_moves", f", {_HELD} select date, cast(len(list_filter(assets, lambda x: not list_contains(before, x))) as integer) as entered, cast(len(list_filter(before, lambda x: not list_contains(assets, x))) as integer) as gone, cast(len(list_distinct(list_concat(assets, before))) as integer) as either, cast(len(list_intersect(assets, before)) as integer) as both from moved where before is not null")
def set_moves(s, d):
    """Union, difference and intersection of the assets held in one month and the next."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "asset"))
    held = P.monthly(s, d).withColumn("r", rank).where("r <= 8").groupBy("date").agg(F.collect_set("asset").alias("assets"))
    both = held.withColumn("before", F.lag("assets").over(Window.orderBy("date"))).where("before is not null")
    size = lambda f, a, b: F.size(f(a, b))
    return both.select("date", size(F.array_except, "assets", "before").alias("entered"), size(F.array_except, "before", "assets").alias("gone"), size(F.array_union, "assets", "before").alias("either"), size(F.array_intersect, "assets", "before").alias("both"))


@query("common_dates", f", {_MOM}, {_QUAL}, {_REG} select date from mmom where momentum is not null intersect select date from mqual where quality is not null intersect select date from regime where z is not null")
def common_dates(s, d):
    g = _monthly(s, d)
    return factors.momentum(g, 12, 1).where("momentum is not null").select("date").intersect(factors.quality(g, 6, 12).where("quality is not null").select("date")).intersect(regime_frame(s, d).where("z is not null").select("date"))


@query("map_rows", "select asset, date, round(close, 9) as close from monthly", digits=9)  # at six, one value of sf0.001 is a tie
def map_rows(s, d):
    """A map of dates to values per asset, and its rows again."""
    maps = P.monthly(s, d).groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct("date", "close"))).alias("m"))
    return maps.select("asset", F.explode("m").alias("date", "close"))


@query("array_windows", ", l as (select asset, list(close order by date) as c from monthly group by asset) select asset, len(c) as n, round(list_max(c), 6) as high, round(c[1], 6) as first, round(list_sum(c[-3:]), 6) as last3, round(list_sum(list_transform(c, lambda x: x * x)), 4) as squares from l")
def array_windows(s, d):
    """Arrays in time order: extremes, slices, transformed sums."""
    c = P.monthly(s, d).groupBy("asset").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("c"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    last3 = F.slice("c", F.greatest(F.lit(1), F.size("c") - 2), 3)
    return c.select("asset", F.size("c").cast("long").alias("n"), F.array_max("c").alias("high"), F.element_at("c", 1).alias("first"), total(last3).alias("last3"), F.round(total(F.transform("c", lambda x: x * x)), 4).alias("squares"))


@query("json_fields", "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as integer)) as bigint) as total, cast(count(distinct json_extract_string(props, '$.k')) as bigint) as kinds from events group by 1")
def json_fields(s, d):
    k = F.get_json_object("props", "$.k")
    return P.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("int")).alias("total"), F.count_distinct(k).alias("kinds"))


@query("top_keys", "select user_id, arg_max(event_type, (n, event_type)) as top, max(n) as n from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def top_keys(s, d):
    """The most frequent key of each user's counts; of equal ones the last by name."""
    n = P.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("best")).select("user_id", F.col("best.event_type").alias("top"), F.col("best.n").alias("n"))


@query("prefix_columns", "select n_nationkey, n_name, n_regionkey from nation join region on n_regionkey = r_regionkey")
def prefix_columns(s, d):
    """Only the columns of one prefix."""
    both = P.table(s, d, "nation").join(F.broadcast(P.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return both.select(*[c for c in both.columns if c.startswith("n_")])


def without_constants(frame: DataFrame) -> DataFrame:
    """Drops the columns that hold one value or none: one pass of minima and maxima."""
    cells = [f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(frame.columns) for k, f in (("a", F.min), ("b", F.max))] + [F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(frame.columns)] + [F.count("*").alias("n")]
    seen = frame.agg(*cells).first()
    keep = [c for i, c in enumerate(frame.columns) if seen[f"n{i}"] and (seen[f"a{i}"] != seen[f"b{i}"] or seen[f"n{i}"] < seen["n"])]
    return frame.select(*keep)


@query("constants_dropped", "select c_custkey, c_mktsegment from customer")
def constants_dropped(s, d):
    return without_constants(P.table(s, d, "customer").select("c_custkey", "c_mktsegment", F.lit("x").alias("source"), F.lit(None).cast("string").alias("nothing")))


_CURVE = "curve_y as (select cast(year(date) as integer) as year, date, ret, exp(sum(ln(1 + ret)) over (partition by year(date) order by date)) as equity from eq), dd_y as (select *, equity / max(equity) over (partition by year order by date rows between unbounded preceding and current row) - 1 as dd from curve_y), kpi_y as (select year, min(dd) as mdd, pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1 as cagr, avg(ret) * sqrt(252) / nullif(stddev_pop(ret), 0) as sharpe, sum(ret) as total from dd_y group by 1)"


def _yearly(s, d) -> DataFrame:
    own = equal_weight(s, d).select("date", "ret", F.year("date").alias("year"))
    return portfolio.window_curves(own, ["year"])


@query("calmar_by_year", f", {_EQ}, {_CURVE} select year, round(mdd, 6) as mdd, round(cagr, 6) as cagr, round(cagr / nullif(abs(mdd), 0), 4) as calmar from kpi_y")
def calmar_by_year(s, d):
    k = portfolio.kpis(_yearly(s, d), ["year"])
    return k.select("year", "mdd", "cagr", F.round(F.try_divide("cagr", F.nullif(F.abs("mdd"), F.lit(0.0))), 4).alias("calmar"))


@query("good_years", f", {_EQ}, {_CURVE} select year, round(sharpe, 6) as sharpe from kpi_y where sharpe > 0 and mdd > -0.5")
def good_years(s, d):
    """A filter on results."""
    return portfolio.kpis(_yearly(s, d), ["year"]).where("sharpe > 0 and mdd > -0.5").select("year", "sharpe")


@query("kpis_over_rate", f", {_EQ}, x as (select ret, ret - 0.02 / 252 as ex from curve) select round(avg(ex) * 252 / (stddev_pop(ex) * sqrt(252)), 6) as sharpe, round(avg(ex) * 252 / (stddev_pop(case when ex < 0 then ex end) * sqrt(252)), 6) as sortino, round(sqrt(252) * avg(ret) / stddev_samp(ret), 6) as sharpe_sample, round(median(ret), 6) as middle, round(min(ret), 6) as least, round(max(ret), 6) as most from x")
def kpis_over_rate(s, d):
    """Ratios over a riskless rate of 2 % a year, the sample-deviation Sharpe ratio, and the median."""
    x = equal_weight(s, d).select("ret", (F.col("ret") - 0.02 / 252).alias("ex"))
    year = F.sqrt(F.lit(252.0))
    return x.agg((F.avg("ex") * 252 / (F.stddev_pop("ex") * year)).alias("sharpe"), (F.avg("ex") * 252 / (F.stddev_pop(F.when(F.col("ex") < 0, F.col("ex"))) * year)).alias("sortino"), (year * F.avg("ret") / F.stddev_samp("ret")).alias("sharpe_sample"), F.percentile("ret", F.lit(0.5)).alias("middle"), F.min("ret").alias("least"), F.max("ret").alias("most"))


@query("equal_width_buckets", ", r as (select min(close) as lo, max(close) as hi from monthly) select cast(least(floor((close - lo) / nullif((hi - lo) / 5, 0)), 4) as integer) as bucket, count(*) as n from monthly, r group by 1")
def equal_width_buckets(s, d):
    m = P.monthly(s, d)
    r = m.agg(F.min("close").alias("lo"), F.max("close").alias("hi"))  # one row
    spot = F.floor((F.col("close") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / 5, F.lit(0.0)))
    return m.crossJoin(F.broadcast(r)).groupBy(F.least(spot, F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("business_month_ends", "select m as month, cast(case when isodow(e) = 6 then e - interval 1 day when isodow(e) = 7 then e - interval 2 day else e end as date) as month_end from (select date as m, cast(date + interval '1 month' - interval '1 day' as date) as e from (select distinct date from monthly))")
def business_month_ends(s, d):
    e = F.last_day("date")
    back = F.when(F.dayofweek(e) == 7, 1).when(F.dayofweek(e) == 1, 2).otherwise(0)
    return P.monthly(s, d).select("date").distinct().select(F.col("date").alias("month"), F.date_sub(e, back).alias("month_end"))


@query("profile_by_asset", "select asset, n_rows, n_dates, n_rows - n_dates as duplicate_keys, null_close, null_volume, cast(place as integer) as place from (select *, row_number() over (order by null_close desc, asset) as place from (select asset, count(*) as n_rows, count(distinct date) as n_dates, count(*) filter (where close is null) as null_close, count(*) filter (where volume is null) as null_volume from dgrid group by 1)) where place <= 5")
def profile_by_asset(s, d):
    """The five assets that lack the most prices, with duplicate keys and missing volumes."""
    per = _daily(s, d).groupBy("asset").agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.count_if(F.col("close").isNull()).alias("null_close"), F.count_if(F.col("volume").isNull()).alias("null_volume"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("null_close"), "asset"))).where("place <= 5").select("asset", "n_rows", "n_dates", (F.col("n_rows") - F.col("n_dates")).alias("duplicate_keys"), "null_close", "null_volume", "place")


@query("close_mean_by_segment_pivot", "select year(o_orderdate) as year, round(avg(case when c_mktsegment = 'AUTOMOBILE' then o_totalprice end), 6) as \"AUTOMOBILE\", round(avg(case when c_mktsegment = 'BUILDING' then o_totalprice end), 6) as \"BUILDING\", round(avg(case when c_mktsegment = 'FURNITURE' then o_totalprice end), 6) as \"FURNITURE\", round(avg(case when c_mktsegment = 'HOUSEHOLD' then o_totalprice end), 6) as \"HOUSEHOLD\", round(avg(case when c_mktsegment = 'MACHINERY' then o_totalprice end), 6) as \"MACHINERY\" from orders join customer on o_custkey = c_custkey group by 1".replace("year(o_orderdate)", "cast(year(o_orderdate) as integer)"))
def close_mean_by_segment_pivot(s, d):
    j = P.table(s, d, "orders").join(P.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = F.avg("o_totalprice")
    return j.groupBy(F.year("o_orderdate").alias("year")).pivot("c_mktsegment", "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY".split()).agg(mean)


_ERF = "sign(z) * (1 - (1 / (1 + 0.3275911 * abs(z / sqrt(2))) * (0.254829592 + 1 / (1 + 0.3275911 * abs(z / sqrt(2))) * (-0.284496736 + 1 / (1 + 0.3275911 * abs(z / sqrt(2))) * (1.421413741 + 1 / (1 + 0.3275911 * abs(z / sqrt(2))) * (-1.453152027 + 1 / (1 + 0.3275911 * abs(z / sqrt(2))) * 1.061405429))))) * exp(-z * z / 2))"


@query("psr_probability", f", {_EQ}, a as (select count(*) as n, avg(ret) as m, stddev_pop(ret) as d from curve), b as (select n, m / d as sr, avg(power((ret - m) / d, 3)) as sk, avg(power((ret - m) / d, 4)) as ku from curve cross join a group by n, m, d), c as (select (sr - 0.01) * sqrt(n - 1.0) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) as z from b) select round(z, 4) as z, round(0.5 * (1 + {_ERF}), 5) as p from c")
def psr_probability(s, d):
    """The probability that the daily Sharpe ratio exceeds 0.01, with daily moments throughout."""
    m = equal_weight(s, d).agg(F.count("*").alias("n"), (F.avg("ret") / F.stddev_pop("ret")).alias("sr"), F.skewness("ret").alias("sk"), (F.kurtosis("ret") + 3).alias("ku"))
    z = (F.col("sr") - 0.01) * F.sqrt(F.col("n") - 1.0) / F.sqrt(1 - F.col("sk") * F.col("sr") + (F.col("ku") - 1) / 4 * F.col("sr") * F.col("sr"))
    m = m.select(z.alias("z"))
    return m.select(F.round("z", 4).alias("z"), F.round(0.5 * (1 + erf(F.col("z") / F.sqrt(F.lit(2.0)))), 5).alias("p"))


@query("frame_hash", "select md5(string_agg(concat_ws('|', n_nationkey, n_name), ';' order by n_nationkey)) as h, count(*) as n from nation")
def frame_hash(s, d):
    """A content hash of a small frame, in the order of its key."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name").alias("x")))), lambda r: r["x"])
    return P.table(s, d, "nation").agg(F.md5(F.array_join(rows, ";")).alias("h"), F.count("*").alias("n"))
