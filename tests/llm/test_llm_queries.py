"""Every query of the subpackage beside its SQL, or run over its whole table."""

import pytest
from compare import DATA, assert_same

from lexspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert assert_same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name, table", [("op5_gam_quality", "documents"), ("op7_mincut_extraction", "pages"), ("op9_pii_surrogates", "documents")])
def test_a_row_for_each_row(spark, name, table):
    small = DATA.replace("sf0.01", "sf0.001")
    assert queries.QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{table}.parquet").count()
