"""The Merkle manifest against a plain version, over trees of every shape."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archlight.llm import manifest

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(hashes):
    """The last node, and for every leaf the siblings before and after it, level by level."""
    at, paths = list(range(len(hashes))), [[] for _ in hashes]
    while len(hashes) > 1:
        for i, k in enumerate(at):
            run = hashes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
        hashes, at = [h(*hashes[k : k + 8]) for k in range(0, len(hashes), 8)], [k // 8 for k in at]
    return hashes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    own = {g: tree([leaf(*r) for r in groups[g]]) for g in langs}
    root, above = tree([own[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, top in zip(langs, above):
        for r, path in zip(groups[g], own[g][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if bad else r[4]
            folded = leaf(*r[:4], text)
            for left, right in path + top:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf(*r), own[g][0], root, h(*(x for left, right in path + top for x in left + right)), folded, folded == root))
    return Counter(out)


def drawn(seed, size, langs):
    dice = random.Random(seed)
    texts = ("Plain text", "lower", "", None, "ÄÖ ß 中文 🤖\x00", "A" * 300_000)
    some = [(dice.choice([None, *range(-3, 3 * size)]), dice.choice(["s", None, "ß"]), dice.choice(langs), dice.choice([None, 0, 12345]), dice.choice(texts[: 6 if size < 30 else 5])) for _ in range(size)]
    return some + some[:2]


@pytest.mark.parametrize(("size", "langs"), [(0, ["en"]), (1, [None]), (1, ["en", "de"]), (7, ["en"]), (8, [None, "", "en"]), (30, ["en", "de", None, "ß", ""]), (700, ["en"] * 30 + ["de", "fr", None]), (40, [f"l{i}" for i in range(20)])])
def test_manifest(spark, size, langs):
    rows = drawn(size, size, langs) if size else []
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g int, leaf string, pos int").repartition(3)
    got = Counter(tuple(r[c] for c in NAMES) for r in manifest.prove(df).select(*NAMES).collect())
    assert got == plain(rows)


def test_tampering_is_seen(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in manifest.prove(docs).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    for i, r in rows.items():
        altered = zlib.crc32(str(i).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[i] or "")
        assert r["verified"] == (not altered)
    assert len({r["root"] for r in rows.values()}) == 1 and len(rows) == docs.count()


def test_one_language(spark):
    """One language with all rows."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    assert manifest.prove(docs).groupBy("root", "subroot").count().collect()[0]["count"] == 20_000
