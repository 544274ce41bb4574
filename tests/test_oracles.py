"""Every query of the reference's operators against DuckDB on the smallest tables."""

import pytest

from flakespark.plans import catalog
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    if name in catalog.oracle_sql():
        same(df, catalog.oracle_sql()[name], con)
    else:
        assert df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
