import pytest

from compare import duck, rows
from conftest import SF
from sieveline import plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = duck(SF).sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
