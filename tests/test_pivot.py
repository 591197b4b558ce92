"""The pivot has a column for each asset."""

from oracle import connection, difference

from meridax.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_all_assets(spark):
    con = connection(DATA)
    assert difference(spark, con, DATA, QUERIES["pivot_matrix"], ORACLES["pivot_matrix"]) is None
    wide = QUERIES["pivot_matrix"](spark, DATA)
    assert set(wide.columns) == {"date"} | {r[0] for r in con.execute("select distinct p_brand from part").fetchall()}
    closes = sum(v is not None for r in wide.drop("date").collect() for v in r)
    assert closes == QUERIES["panel_monthly"](spark, DATA).where("close is not null").count()
