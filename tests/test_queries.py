"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = f"{oracle.ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.compare(df, con, sql) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["moneylevel", "painlevel", "accepted"] and df.count() > 0
