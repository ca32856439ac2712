"""Every registered query against its SQL, or for rows where SQL can't say it."""

import pytest

from tessera.plans import ORACLE_SQL, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert not oracle.differences(df, ORACLE_SQL[name], con)
    else:
        assert df.count() > 0
