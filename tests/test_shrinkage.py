import pytest

from meridax.operators import portfolio


def test_unknown_shrinkage_is_an_error(spark):
    cov = spark.createDataFrame([("d", "a", "a", 1.0)], "date string, asset_i string, asset_j string, cov double")
    with pytest.raises(ValueError, match="ledoit_wolf"):
        portfolio.shrunk(cov, "ledoit_wolf", 0.2)
