"""The corpus pipeline, each stage against a plain version on its own input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from archlight.llm import packing
from archlight.llm.common import settle, table

from ..conftest import duck
from . import brute


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    inputs = []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = settle(stage(spark, docs, sf), "stage")
    raw, clean, good, single, cut, packed = (d.toPandas() for d in [*inputs, docs])
    columns = list(raw.columns)
    assert all(list(d.columns) == columns for d in (clean, good, single, cut))
    from archlight.llm.queries import ORACLE_SQL

    verdict = duck(sf).sql(ORACLE_SQL["op1_quality_rules"]).df()
    assert sorted(clean.doc_id) == sorted(verdict[verdict.kept].doc_id) and (clean.n_chars == clean.text.str.len()).all()
    labels = table(spark, sf, "labels").toPandas()
    bad = set(labels[labels.quality == 0].doc_id)
    assert set(good.doc_id) <= set(clean.doc_id) and not set(good.doc_id) & bad and len(good) > 0.98 * len(clean[~clean.doc_id.isin(bad)])
    parts = brute.components(list(zip(good.doc_id, good.text)), corpus_pipeline.NEAR_PERCENT)
    assert sorted(single.doc_id) == sorted(i for i, (_, c) in parts.items() if i == c)
    want = {w[0]: w[5] for w in brute.long_matches(list(zip(single.doc_id, single.text)))}
    assert dict(zip(cut.doc_id, cut.text)) == want
    assert set(packed.doc_id) == set(cut.doc_id)
    fill = packed.groupby("sequence_id").length.sum()
    assert fill.max() <= packing.CAPACITY and len(fill) <= 1.1 * packed.length.sum() / packing.CAPACITY + 1


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, and extra columns with clashing names."""
    draw = random.Random(2)
    line = lambda: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(11)).capitalize() + "."
    text = lambda n: "\n".join(line() for _ in range(n))
    long, one, two = text(6000), text(9), text(12)
    near = one.replace(one.split()[3], "otherword", 1)
    rows = [(1, one, "en", "a"), (2, one, "en", "a"), (3, near, None, None), (4, two, "en", None), (4, two, "en", None), (None, two, None, "b"), (None, None, None, None), (5, "", "en", "a"), (6, None, "en", "a"), (7, long, "en", "b"), (8, two + "\n" + text(8), "fr", "a")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(None).cast("int") for c in ("row", "kept", "k1", "c", "g", "id", "_kept", "_host", "lines", "copies")})


def test_stages_with_odd_rows(spark, sf):
    docs = odd_documents(spark)
    columns = docs.columns
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), "stage")
        left.append(sorted(((r["doc_id"]) for r in docs.collect()), key=repr))
        assert name == "packing" or docs.columns == columns
    assert left[0] == left[1] == sorted([1, 2, 3, 4, 4, 7, 8, None], key=repr)
    assert left[2] == left[3] == sorted([1, 4, 7, 8, None], key=repr)
    assert set(left[4]) == {1, 4, 7, 8, None}


def test_stages_of_an_empty_table(spark, sf):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), "stage")
        assert docs.count() == 0
