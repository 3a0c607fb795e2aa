import pytest

from tessera.plans import suite
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_matches_sql(spark, con, name):
    df = suite.QUERIES[name](spark, SF)
    if name in suite.SQL:
        same(df, con, suite.SQL[name])
    else:
        assert df.count() >= 0
