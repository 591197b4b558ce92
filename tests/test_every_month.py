"""Covariances and what inherits their dates, at every month with a full window."""

import pytest
from oracle import connection, difference

from meridax.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
WITH_SQL = "rolling_cov_pairs shrink_diagonal shrink_identity shrink_constant_correlation corr_distance_quantile node_degree components vol_scaled_weights asof_cov interval_windows".split()


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, name):
    assert difference(spark, connection(DATA), DATA, QUERIES[name], ORACLES[name]) is None


def test_no_month_is_left_out(spark):
    months = sorted(r[0] for r in connection(DATA).execute("select distinct cast(date_trunc('month', l_shipdate) as date) from lineitem").fetchall())
    dates = lambda name, column="date": sorted({r[0] for r in QUERIES[name](spark, DATA).select(column).collect()})
    # padded returns begin in month 2, or later where no asset has a price in each month
    covered = dates("rolling_cov_pairs")
    assert covered == months[months.index(covered[0]) :]
    assert dates("mst_edges") == dates("hrp_weights") == covered
    assert dates("interval_windows", "window_end") == months[11:]
    assert all(r.cov_date == r.date for r in QUERIES["asof_cov"](spark, DATA).collect() if r.date >= covered[0])
