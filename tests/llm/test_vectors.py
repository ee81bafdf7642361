"""Vector codes and near-duplicate vectors against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from archlight.llm import vector_codes, vector_dups

SCHEMA = "vec_id long, embedding array<float>, label int, code string, node long, n int"
ODD = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.5, 0.25] * 2, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] + [0.0] * 7, 2), (905, [0.0] * 8, None), (906, [0.0] * 8, 1), (907, [3.0e38, -3.0e38] * 4, 1), (908, [0.5] * 4, 1), (909, [0.5] * 5, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA).repartition(5)


# 11


def plain_codes(rows, entries, rounds=4):
    """``(vec_id, code, error, label_error, sha)`` as a multiset, one part and entry after another."""
    fit = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and len(v) % 4 == 0 and all(x is not None and abs(x) < 2**17 for x in v)]
    fit.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fit = [r for r in fit if len(r[1]) == len(fit[0][1])]
    if not fit:
        return Counter()
    d = len(fit[0][1]) // 4
    cut = lambda v, k: v[k * d : (k + 1) * d]
    books = [[cut(r[1], k) for r in fit[:entries]] for k in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            chosen = {}
            for r in fit:
                chosen.setdefault(near(cut(r[1], k), books[k])[1], []).append(cut(r[1], k))
            books[k] = [[sum(c) // len(chosen[e]) for c in zip(*chosen[e])] if e in chosen else b for e, b in enumerate(books[k])]
    found = [[near(cut(r[1], k), books[k]) for k in range(4)] for r in fit]
    by_label = Counter()
    for r, f in zip(fit, found):
        by_label[r[2]] += sum(x for x, _ in f)
    sha = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{e:02x}" for _, e in f), sum(x for x, _ in f), by_label[r[2]], sha) for r, f in zip(fit, found))


def drawn(seed, size, width, grid):
    dice = random.Random(seed)
    step = (lambda: dice.choice((-0.5, 0.0, 0.25, 0.5))) if grid else (lambda: dice.gauss(0, 0.3))
    rows = [(dice.choice((None, *range(2 * size))), [float(np.float32(step())) for _ in range(width)], dice.choice((None, 0, 1, 1, 1, 2))) for _ in range(size)]
    return rows + rows[:5]


@pytest.mark.parametrize(("size", "width", "grid", "entries"), [(0, 8, True, 256), (1, 8, False, 256), (120, 8, True, 16), (400, 80, False, 32), (90, 20, False, 256)])
def test_codes(spark, monkeypatch, size, width, grid, entries):
    monkeypatch.setattr(vector_codes, "ENTRIES", entries)
    rows = (drawn(size, size, width, grid) if size else []) + ODD
    if width == 20:
        rows = rows[:-1]  # five components do not make four parts
    got = vector_codes.compress(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == plain_codes(rows, entries)
    assert vector_codes.compress(frame(spark, rows).where("vec_id in (900, 902)")).collect() == []


@pytest.mark.parametrize("large", [1, 2**26])
def test_partial_distances(large):
    dice = np.random.default_rng(large)
    for entries, width in ((1, 1), (7, 3), (256, 16), (40, 33)):
        x, book = (dice.integers(-3, 4, (n, width)) * large for n in (3000, entries))
        found, far = vector_codes.nearest(x, book)
        all_ = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (found == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()


# 12


def plain_links(rows, threshold=0.93):
    """(vec_id, links, component, kept) of every row, by comparing all pairs."""
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: (lambda v: v / np.linalg.norm(v))(np.array(rows[k][1]) / max(map(abs, rows[k][1]))) for k in good}
    root, links = {rows[k][0]: rows[k][0] for k in good}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = find(i) if k in unit else i
        out.append((i, links[k], c, i is None or i == c))
    return Counter(out)


def around(dice, centre, cosine):
    side = dice.standard_normal(len(centre))
    side -= (side @ centre) * centre
    return cosine * centre + math.sqrt(1 - cosine * cosine) * side / np.linalg.norm(side)


def groups(seed, sizes, width=48):
    """Vectors around centres, at cosines that put pairs on both sides of the threshold."""
    dice = np.random.default_rng(seed)
    rows = []
    for g, size in enumerate(sizes):
        centre = dice.standard_normal(width)
        centre /= np.linalg.norm(centre)
        rows += [(around(dice, centre, dice.uniform(0.94, 0.999)) * dice.uniform(0.1, 9), g % 3) for _ in range(size)]
    ids = dice.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in v], lab) for i, (v, lab) in zip(ids, rows)]


@pytest.mark.parametrize("limit", [1024, 8])
def test_links(spark, monkeypatch, limit):
    monkeypatch.setattr(vector_dups, "LIST", limit)
    rows = groups(limit, [60, 1, 1, 9, 4, 30, 2, 2, 2, *[1] * 80])
    rows += [(7000 + k, rows[k][1], rows[k][2]) for k in range(6)] * 2 + [(None, rows[0][1], 0), (8000, rows[0][1], None), *ODD]  # equal and repeated rows
    got = Counter(tuple(r) for r in vector_dups.report(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
    want = plain_links(rows)
    assert sum(got.values()) == sum(want.values()) == len(rows)
    total = lambda c: sum(k[1] * n for k, n in c.items())
    assert total(got) <= total(want) and total(got) >= 0.99 * total(want)
    assert sum((got & want).values()) >= 0.97 * len(rows)


def test_few_vectors(spark):
    for rows in ([], [(1, [1.0, 2.0], 3)], [(1, [1.0, 2.0], 3), (2, [2.0, 4.1], 3), (3, [2.0, 4.1], 4), (4, [-1.0, -2.0], 3)]):
        got = Counter(tuple(r) for r in vector_dups.report(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
        assert got == plain_links(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at 0.93 to 0.95 among many others: at least 0.98 are found, and none below the threshold."""
    dice = np.random.default_rng(5)
    base = dice.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(2 * k + j, [float(x) for x in v], 1) for k, b in enumerate(base) for j, v in enumerate((b, around(dice, b, 0.9301 + 0.02 * k / 1500)))]
    got = {r["vec_id"]: r["n_links"] for r in vector_dups.report(frame(spark, rows)).collect()}
    assert sum(got.values()) >= 0.98 * len(rows) and max(got.values()) == 1
    far = [(2 * k + j, [float(x) for x in v], 1) for k, b in enumerate(base[:300]) for j, v in enumerate((b, around(dice, b, 0.9298)))]
    assert not any(r["n_links"] for r in vector_dups.report(frame(spark, far)).collect())
