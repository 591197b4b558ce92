"""Files, settings, kept tables, sinks and the command line."""

import datetime
import json

import pytest

from meridax import __main__, config
from meridax.sources import panel, store


def test_csv_panel(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Close,Volume\n2024-01-02,10.5,100\n2024-01-03,-1,5\nbad,1,1\n2024-01-04,nan,-3\n")
    (tmp_path / "BBB.csv").write_text("Date,Close,Volume\n2024-01-02,7,1\n2024-02-02,8,2\n")
    got = {(r.asset, str(r.date)): (r.close, r.volume) for r in panel.read_csv(spark, str(tmp_path), "2024-01-01", "2024-01-31").collect() if r.date}
    assert got == {("AAA", "2024-01-02"): (10.5, 100.0), ("AAA", "2024-01-03"): (None, 5.0), ("AAA", "2024-01-04"): (None, None), ("BBB", "2024-01-02"): (7.0, 1.0)}
    with pytest.raises(FileNotFoundError):
        panel.read_csv(spark, str(tmp_path / "none"))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "C.csv").write_text("date,price\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="close"):
        panel.read_csv(spark, str(tmp_path / "x"))


def test_rates_and_index(spark, tmp_path):
    (tmp_path / "rates.csv").write_bytes("Série diária\nData;Fator diário\n02/01/2024;1,00043739\n03/01/2024;1.000,5\n;\n".encode("latin-1"))
    assert [(str(r.date), round(r.rate, 8)) for r in panel.read_rates(spark, str(tmp_path / "rates.csv")).orderBy("date").collect()] == [("2024-01-02", 0.00043739), ("2024-01-03", 999.5)]
    (tmp_path / "index.csv").write_text("Close,Date\n200,2024-01-03\n100,2024-01-02\n,2024-01-04\n")
    assert [r.rebased for r in panel.read_index(spark, str(tmp_path / "index.csv")).orderBy("date").collect()] == [1.0, 2.0]


def test_grid_keeps_rows_and_adds_gaps(spark):
    rows = [(datetime.date(2024, 1, d), a, 1.0 * d, None) for d, a in ((1, "A"), (2, "B"), (2, "A"))]
    frame = spark.createDataFrame(rows, "date date, asset string, close double, volume double")
    assert sorted((r.date.day, r.asset, r.close) for r in panel.grid(frame).collect() if r.close) == [(1, "A", 1.0), (2, "A", 2.0), (2, "B", 2.0)]
    assert panel.grid(frame).count() == 4 and panel.grid(frame.where("false")).count() == 0


def test_a_grid_reads_the_panel_once(spark):
    frame = panel.grid(panel.daily(spark, "/root/testdata/sf0.001"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 2 and "ReusedExchange" in final  # line items and parts


def test_kept_tables_and_sinks(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3).toDF("n")
    for _ in range(2):
        assert store.cached(spark, str(tmp_path / "kept"), "t", make, start="2024-01-01", end="2024-02-01").count() == 3
    store.cached(spark, str(tmp_path / "kept"), "t", make, start="2024-01-01", end="2024-03-01")
    assert len(calls) == 2
    frame = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    store.write_csv(frame, str(tmp_path / "csv"), ["k"])
    store.write_json(frame, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    store.append_metrics(frame, str(tmp_path / "metrics"), "run")
    assert sorted(r.value for r in store.read_metrics(spark, str(tmp_path / "metrics")).collect()) == [1.0, 2.0]
    mark = store.signature(spark, str(tmp_path / "json" / "*.json"))
    store.write_json(frame.limit(1), str(tmp_path / "json"))
    assert store.signature(spark, str(tmp_path / "json" / "*.json")) != mark


def test_settings(tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"data": {"path": "x"}, "rules": {"target_vol": "0.1", "method": "hrp_only"}, "universe": {"top_n": "5"}}))
    settings = config.load(str(path))
    assert settings["universe"]["top_n"] == 5 and config.rules_of(settings).target_vol == 0.1
    assert config.rules_of(config.put(settings, "rules.turnover_cap", 0.5)).turnover_cap == 0.5 and "turnover_cap" not in settings["rules"]
    for bad in ({"other": {}}, {"universe": {"other": 1}}, {"rules": {"other": 1}}, {"rules": {"method": "x"}}, {"rules": {"target_vol": 0}}, {"output": {"kind": "png"}}, [1]):
        with pytest.raises(ValueError):
            config.checked(bad)


def test_command_line(spark, tmp_path, capsys):
    __main__.main(["list"])
    assert "panel_daily" in capsys.readouterr().out.split()
    __main__.main(["query", "hash_md5", "/root/testdata/sf0.001", str(tmp_path / "out"), "--kind", "json"])
    assert spark.read.json(str(tmp_path / "out")).count() == 25
    with pytest.raises(SystemExit):
        __main__.main(["query", "other", "a", "b"])
    for k, name in enumerate(("AAA", "BBB")):
        days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(130)]
        (tmp_path / f"{name}.csv").write_text("date,close,volume\n" + "\n".join(f"{t},{100 + i * 0.1 + (i * (7 + k)) % 5},1000" for i, t in enumerate(days)))
    (tmp_path / "run.json").write_text(json.dumps({"data": {"path": str(tmp_path)}, "rules": {"lookback": 40}, "output": {"path": str(tmp_path / "run"), "kind": "csv"}}))
    __main__.main(["backtest", str(tmp_path / "run.json")])
    assert spark.read.option("header", True).csv(str(tmp_path / "run" / "days")).count() == 130
