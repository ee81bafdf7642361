"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest

from archlight.plans import registry

from .conftest import duck, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got.columns)
        return
    want = con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_vector_documents_of_all_files(spark, sf):
    got = registry.QUERIES["vector_documents"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    estate = got[got.id.str.extract(r"(\d+)\.txt$")[0].astype(int) % 5 == 1]
    assert len(estate) and estate.document.str.contains('"Legal":[{"item":"Will ', regex=False).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
