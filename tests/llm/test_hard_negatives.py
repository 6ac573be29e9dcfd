"""Hard negatives against a plain version over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketrank.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, anchor long, shard string"


def plain(rows, every, rules=hn.Rules()):
    """Sorted result rows, from the scores of all pairs."""
    taken = []
    for vec_id, label, vec in rows:
        if vec_id is None or label is None or vec is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vec):
            continue
        taken.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    for anchor, label, a in taken:
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i, l) for i, l, b in taken if i != anchor]
        scored.sort()
        for minus, positive, _ in [s for s in scored if s[2] == label][: rules.positives]:
            p = -minus
            fit = [s for s in scored if s[2] != label and rules.least * p <= -100 * s[0] <= rules.most * p]
            out += [(anchor, positive, r, i, p, -m) for r, (m, i, _) in enumerate(fit[: rules.negatives], 1)]
    return sorted(out)


def made(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    found = hn.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def cloud(n, dims, labels, seed):
    """Rows around a few centres, a third of them copies of one vector."""
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(6, dims))
    vectors = centres[dice.integers(0, 6, n)] * 0.3 + dice.normal(size=(n, dims)) * 0.1
    vectors[::3] = vectors[0]
    return [
        (int(i), int(dice.integers(0, labels)), [float(np.float32(x)) for x in vectors[i]])
        for i in dice.permutation(n)
    ]


@pytest.mark.parametrize("shard_rows,centres", [(4096, 256), (40, 5), (7, 3)])
def test_equals_the_plain_version(spark, shard_rows, centres):
    rows = cloud(600, 8, 4, 1)
    want = plain(rows, 10)
    assert len(want) > 300
    assert made(spark, rows, 10, shard_rows=shard_rows, centres=centres) == want


def test_hard_rows(spark):
    rows = cloud(120, 5, 2, 2)
    rows += rows[:30]  # repeated rows, anchors among them
    rows += [
        (1000, 1, None),
        (1010, None, [0.1] * 5),
        (None, 1, [0.5] * 5),
        (1020, 1, [0.1, None, 0.1, 0.1, 0.1]),
        (1030, 1, [float("nan"), 0.1, 0.1, 0.1, 0.1]),
        (1040, 1, [float("inf"), 0.1, 0.1, 0.1, 0.1]),
        (1050, 1, []),
        (1060, 1, [0.5, 0.5]),
        (1070, 1, [0.0] * 5),
        (1080, 7, [0.3] * 5),  # the only row of its label
        (1090, 0, [-0.9] * 5),  # negative scores with most others
        (-1100, 0, [0.2] * 5),
    ]
    for shard_rows in (4096, 9):
        assert made(spark, rows, 10, shard_rows=shard_rows, centres=4) == plain(rows, 10)


def test_empty_tables(spark):
    assert made(spark, [], 10) == []
    assert made(spark, [(1, None, None), (10, 1, None)], 10) == []
    assert made(spark, [(10, 1, [0.5, 0.5])], 10) == []


def test_scores_that_do_not_fit_raise(spark):
    with pytest.raises(ValueError, match="64 bits"):
        made(spark, [(10, 1, [1e30, 1.0]), (20, 2, [1.0, 1.0])], 10)


def shard_of(rows, centres, sample):
    """One shard with all rows, its books fitted on a part."""
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    vectors = np.floor(np.array([r[2] for r in rows]) * 256).astype(np.int64)
    cut = vectors.shape[1] // 2
    floats = vectors.astype(float)
    books = hn.Codebooks(tuple(hn.fit_centres(h, centres) for h in (floats[:sample, :cut], floats[:sample, cut:])))
    codes, far = books.nearest(floats)
    books.radii = tuple(
        np.array([f[c == k].max(initial=0) for k in range(len(z))]) for c, f, z in zip(codes, far, books.centres)
    )
    return books, hn.Shard(books, ids, labels, vectors, *codes), vectors


def test_bounds_hold_and_cells_come_by_falling_bound():
    rows = cloud(500, 16, 3, 4)
    books, shard, vectors = shard_of(rows, 9, 60)
    dice = random.Random(1)
    for i in dice.sample(range(500), 20):
        visits = list(shard.visit(vectors[i].astype(float)))
        bounds = [v[0] for v in visits]
        assert bounds == sorted(bounds, reverse=True)
        assert sorted(r for _, lo, hi in visits for r in range(lo, hi)) == list(range(500))
        for bound, lo, hi in visits:
            assert (shard.vectors[lo:hi] @ vectors[i]).max() <= bound


def test_search_stops_before_all_cells_on_clustered_rows():
    dice = np.random.default_rng(7)
    centres = dice.normal(size=(40, 16))
    rows = [(i, i % 3, (centres[i % 40] + dice.normal(size=16) * 0.01).tolist()) for i in range(4000)]
    books, shard, vectors = shard_of(rows, 40, 4000)
    visited = 0
    for i in range(0, 4000, 400):
        best = sorted((-(vectors[i] @ v), r[0]) for r, v in zip(rows, vectors) if r[1] == i % 3 and r[0] != i)[:5]
        counted = []
        wrapped = shard.scored
        shard.scored = lambda v, n: ((counted.append(len(r)), (r, s))[1] for r, s in wrapped(v, n))
        ids, scores = shard.positives(i, i % 3, vectors[i], 5, -np.inf)
        shard.scored = wrapped
        assert list(zip((-scores).tolist(), ids.tolist())) == best
        visited += sum(counted)
    assert visited < 10 * 4000 * 0.25
