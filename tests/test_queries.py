"""Every registered query against its SQL on the smallest tables; the fits are in test_models."""

import pytest

import __spark_entry__ as driver
from checks.compare import differences, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

SLOW = {"lr_fit_score", "gbt_fit_score", "mlp_fit_score"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_matches_sql(spark, con, sf_dir, name):
    mine = driver.queries()[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert differences(mine, con.execute(ORACLES[name]).df()) == []
    else:
        assert len(mine) > 0


def test_entry_has_rows_and_schema(spark):
    df = driver.entry(spark)
    assert df.columns == ["ST", "state_population"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
