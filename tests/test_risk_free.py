"""All observed rates on all business days between the first and the last of them."""

import datetime

from oracle import connection, difference

from meridax.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert difference(spark, connection(DATA), DATA, QUERIES["risk_free_aligned"], ORACLES["risk_free_aligned"]) is None


def test_gaps_are_filled_and_no_rate_is_left_out(spark, tmp_path):
    day = lambda m, d: datetime.datetime(2023, m, d, 12)
    # Tue 30 May to Thu 8 June, none on Wed and Mon, one on Saturday, two on Friday; another type on Wed
    rows = [(day(5, 30), "purchase", 1.0), (day(6, 1), "purchase", 2.0), (day(6, 2), "purchase", 3.0), (day(6, 2), "purchase", 5.0), (day(6, 3), "purchase", 9.0), (day(6, 6), "purchase", 6.0), (day(6, 8), "purchase", 8.0), (day(5, 31), "view", 99.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.date.month, r.date.day): r.rate for r in QUERIES["risk_free_aligned"](spark, str(tmp_path)).collect()}
    assert got == {(5, 30): 1, (5, 31): 1, (6, 1): 2, (6, 2): 4, (6, 5): 4, (6, 6): 6, (6, 7): 6, (6, 8): 8}
