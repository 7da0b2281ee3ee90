"""Every registered query with SQL equals it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import SF_DIR, compare


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]).startswith("ok")
