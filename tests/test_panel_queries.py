import pytest
from oracle import connection, difference

from meridax.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = "panel_monthly momentum_top5 quality_6 regime_index mix_tanh shrink_constant_correlation universe_hysteresis purged_folds time_under_water trade_costs".split()


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    assert difference(spark, connection(DATA), DATA, QUERIES[name], ORACLES[name]) is None


def test_hierarchical_weights_of_two_assets_are_inverse_variances():
    import pandas as pd

    from meridax.operators.graphs import hierarchical_weights

    cov = pd.DataFrame([("d", "a", "a", 1.0), ("d", "a", "b", 0.0), ("d", "b", "a", 0.0), ("d", "b", "b", 3.0)], columns=["date", "asset_i", "asset_j", "cov"])
    weights = hierarchical_weights(cov).set_index("asset")["weight"]
    assert weights["a"] == pytest.approx(0.75) and weights.sum() == pytest.approx(1)
