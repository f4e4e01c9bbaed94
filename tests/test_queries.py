"""Every query of the library: beside its SQL on whole tables, or run to its end."""

import pytest
from compare import DATA, assert_same

from lexspark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert assert_same(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_on_whole_tables(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["lang", "type", "n"]
