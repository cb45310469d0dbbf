"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

from tests.oracle import compare
from weftlight.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that give no row on these tables, as no text has what they look for.
EMPTY = {"relation_extraction"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.ORACLE_SQL:
        assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""
    else:
        assert (catalogue.QUERIES[name](spark, SF).count() > 0) == (name not in EMPTY)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
