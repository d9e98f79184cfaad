import pytest
from support import check

from geoloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    assert check(spark, catalogue.queries()[name], catalogue.oracle_sql()[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.01").count() > 0
