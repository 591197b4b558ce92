import datetime

import numpy as np
import pytest
from oracle import connection, difference

from meridax.operators import resampling
from meridax.registry import ORACLES, QUERIES
from meridax.sources import run_log
from meridax.streaming import windows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["psr_zscore", "stream_daily_events"])
def test_query_equals_sql(spark, name):
    assert difference(spark, connection(DATA), DATA, QUERIES[name], ORACLES[name]) is None


def test_permutation_and_bootstrap(spark):
    draw = np.random.default_rng(3)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(250)]
    rows = [("up", t, 0.01 + 0.005 * float(x)) for t, x in zip(days, draw.normal(size=250))] + [("flat", t, 0.0) for t in days] + [("up", days[0], None)]
    series = spark.createDataFrame(rows, "asset string, date date, ret double")
    got = {r.asset: r for r in resampling.permutation_pvalues(series, count=200, trials=9).collect()}
    assert set(got) == {"up"} and got["up"].p_value == pytest.approx(1 / 201) and got["up"].deflated_p == pytest.approx(1 - (200 / 201) ** 9)
    values = np.array([r[2] for r in rows if r[0] == "up" and r[2] is not None])
    samples = [resampling.sharpe(resampling.moved(values, 21, np.random.default_rng([42, k]))) for k in range(200)]
    ci = {(r.asset, r.metric): r for r in resampling.bootstrap_intervals(series, count=200).collect()}
    assert [ci["up", "sharpe"][c] for c in ("low", "mid", "high")] == pytest.approx(np.quantile(samples, [0.025, 0.5, 0.975]))
    assert ci["flat", "sharpe"].low is None and ci["flat", "mdd"].mid == 0


def test_late_days_wait_for_the_watermark(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    frame = lambda days: spark.createDataFrame([(at + datetime.timedelta(k), "view", 1.0) for k in days], "ts timestamp_ntz, event_type string, value double").coalesce(1)
    path, folder = str(tmp_path / "events"), str(tmp_path / "stream")
    frame([0, 0, 1]).write.parquet(path)
    assert [(r.date.day, r.n) for r in windows.drained(spark, path, windows.daily_counts, folder).collect()] == [(1, 2)]
    frame([0, 2]).write.mode("append").parquet(path)  # the first day is closed, so its event comes too late
    assert sorted((r.date.day, r.n) for r in windows.drained(spark, path, windows.daily_counts, folder).collect()) == [(1, 2), (2, 1)]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    run_log.append_run(spark, path, "a", {"risk": {"caps": [1, None]}}, {"sharpe": 1.5}, {})
    run_log.append_run(spark, path, "b", {"other": True}, {}, {"note": "x"})
    got = {r.run_id: r.entries for r in run_log.read_runs(spark, path).collect()}
    assert got == {"a": {"risk.caps.0": "1", "risk.caps.1": "", "metric.sharpe": "1.5"}, "b": {"other": "True", "meta.note": "x"}}
