"""Every query that SQL can express gives the rows of its SQL; every other one runs."""

import pytest
from compare import frame_rows, sql_rows

from knowspark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf, name):
    cols, rows = frame_rows(catalogue.QUERIES[name](spark, sf))
    if name in catalogue.ORACLE:
        assert (cols, rows) == sql_rows(duck, catalogue.ORACLE[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
