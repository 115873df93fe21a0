"""Every registered query against its SQL, on the smallest tables."""

import pytest

from weftwork.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, compare):
    compare(QUERIES[name], ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
