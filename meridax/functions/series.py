"""Window functions over time, per asset, and over assets, per date. On a dense grid a row is a step of time."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_time():
    return Window.partitionBy("asset").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def last_rows(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def lag_return(close: Column) -> Column:
    """One step's return without padding; null where a price is missing."""
    return F.try_divide(close, F.lag(close).over(by_time())) - 1


def filled(x: Column, window=None) -> Column:
    return F.last(x, ignorenulls=True).over((window or by_time()).rowsBetween(Window.unboundedPreceding, 0))


def back_filled(x: Column, window=None) -> Column:
    return F.first(x, ignorenulls=True).over((window or by_time()).rowsBetween(0, Window.unboundedFollowing))


def rolling(function, x: Column, n: int, least: int | None = None, window=None) -> Column:
    """``function`` over n rows, null where fewer than ``least`` (n) values are present."""
    frame = (window or by_time()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), function(x).over(frame))


def zscore(x: Column) -> Column:
    """Cross-sectional, population deviation; 0 where there is no spread, null stays null."""
    mean, deviation = F.avg(x).over(by_date()), F.stddev_pop(x).over(by_date())
    return F.when(x.isNotNull(), F.when(deviation > 0, (x - mean) / deviation).otherwise(0.0))


def winsorized(x: Column, low: float = 0.05, high: float = 0.95) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, F.lit(low)).over(by_date())), F.percentile(x, F.lit(high)).over(by_date())))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    e = F.exp((x - F.max(x).over(by_date())) / temperature)
    return e / F.sum(e).over(by_date())


def ewm(x: Column, span: int, window) -> Column:
    """Exponential mean, weights not adjusted, over the ordered values up to each row; nulls are skipped.

    Rows so far back that their weight is below the precision of a double (e to the -40th) are left out, so a row's work is bounded.
    """
    alpha = 2.0 / (span + 1)
    past = F.collect_list(x).over((window or by_time()).rowsBetween(-math.ceil(40 / alpha), 0))
    return F.aggregate(past, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(a * (1 - alpha) + v * alpha))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))
