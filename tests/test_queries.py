"""Every query against its SQL on the smallest tables."""

import pytest

from cinderplan import queries
from tests.conftest import DATA, rows

SLOW = {"spread_grouped", "spotting_spread"}  # test_spread has small runs of these


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - SLOW))
def test_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
