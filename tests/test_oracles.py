"""Every registered query of the procurement engine against its DuckDB equivalent."""

import pytest

from bidflow.plans import catalog
from tests.compare import SF_DIR, database, rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert rows(QUERIES[name](spark, SF_DIR).toPandas()) == rows(con.sql(SQL[name]).df())


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) == set(SQL)


def test_fuzzy_headers(spark):
    from bidflow.functions.headers import fuzzy_fields

    found = {r["header"]: r for r in fuzzy_fields(spark.createDataFrame([("closing dates",), ("zzz",), (None,), ("Agencys",)], "h string"), "h").collect()}
    assert found["closing dates"]["field"] == "closing_at" and found["Agencys"]["field"] == "agency"
    assert found["zzz"]["field"] is None and found[None]["field"] is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
