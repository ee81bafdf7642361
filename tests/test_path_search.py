"""Indexed substring search against a scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from archlight.functions import predicates as P
from archlight.operators import path_search

PATHS = [None, "", "/a", "/Archive/One.TXT", "/archive/two.txt", "/archive/ünï/三四五六.pdf", "/archive/one", "abcabcabc", "/archive/one.txt"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, p, "complete" if i % 2 else "failed") for i, p in enumerate(PATHS)], "manifest_idx long, file_path string, status string").repartition(3)
    return path_search.build(rows, str(tmp_path_factory.mktemp("grams")))


@pytest.mark.parametrize("term", ["one.txt", "  ARCHIVE/o", "", "a", "三四五", "abcabca", "abd", "/archive/", "e/one.txt and more", "xone"])
def test_search(index, term):
    got = path_search.search(index, term)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in index.rows.where(P.search(term)).collect())
    again = path_search.search_with_fallback(index, term)
    assert sorted(r[0] for r in again.collect()) == sorted(r[0] for r in P.search_with_fallback(index.rows, term).select("manifest_idx").collect())


def test_rarest_first(index):
    assert index.lists("/archive/two") == ["/tw", "e/t", "two"] and index.lists("two nothing") is None
    plan = path_search.search(index, "two.txt")._jdf.queryExecution().toString()
    assert "EqualTo(gram," in plan and path_search.search(index, "two.txt").where(F.col("file_path").isNotNull()).count() == 1
