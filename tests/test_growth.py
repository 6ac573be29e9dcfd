"""What a task holds must not follow the input."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import plan, rows

from pyspark.sql import functions as F

from basketrank.functions import staging
from basketrank.functions.vectors import Kinds, top_k_by_dot, top_k_by_kind
from basketrank.operators import covisit, embedding


@pytest.fixture
def bought(spark):
    """300 customers, one of whom bought 40 items, null among the customers."""
    rng = np.random.default_rng(5)
    sizes = {c: 4 for c in range(300)} | {7: 40, None: 6}
    data = [(c, f"i{i:02d}") for c, n in sizes.items() for i in rng.choice(60, n, replace=False)]
    near = [(f"i{i:02d}", f"i{j:02d}", int(rng.integers(1, 9))) for i in range(60) for j in rng.choice(60, 9, False) if i != j]
    return (
        spark.createDataFrame(data, "customer_id int, item_id string"),
        spark.createDataFrame(near, "item_id string, co_item_id string, score long"),
        data, near,
    )


@pytest.mark.parametrize("limit", [None, 0])
def test_covisit_sums_of_customers_cut_by_batches(spark, bought, limit):
    """The sums do not lie in one hash table per task; a customer may span batches."""
    history, near, data, pairs = bought
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = covisit.covisit_candidates(history, near, 5, limit_bytes=limit)
        text = plan(got)
        found = sorted(map(repr, map(tuple, got.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    owned: dict = {}
    for c, i in data:
        owned.setdefault(c, set()).add(i)
    want = []
    for c, mine in owned.items():
        sums: dict = {}
        for a, b, s in pairs:
            if a in mine and b not in mine:
                sums[b] = sums.get(b, 0) + s
        best = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:5]
        want += [(c, i, s, p) for p, (i, s) in enumerate(best, 1)]
    assert found == sorted(map(repr, want))
    assert "MapInArrow" in text


def test_pairs_are_counted_in_parts_that_follow_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lines of bills")
    spark.range(4000).selectExpr("id % 900 AS bill_id", "concat('i', id % 37) AS item_id").write.parquet(path)
    lines = spark.read.parquet(path)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert staging.parts_for(lines) == least
    before = rows(covisit.pair_counts(covisit.bill_items(lines)))
    monkeypatch.setattr(staging, "BYTES_PER_PART", 200)
    parts = staging.parts_for(lines)
    assert parts > 2 * least
    for limited in (True, False):
        found = covisit.pair_counts(covisit.bill_items(lines), limited)
        assert "hashpartitioning(chunk#" in plan(found) and f", {parts})" in plan(found)
        assert rows(found) == before


@pytest.fixture
def alike(spark):
    """400 items with 8 different vectors, two of which give equal scores, and 30 customers with up to 5 seen items."""
    rng = np.random.default_rng(3)
    vecs = rng.integers(-3, 4, (8, 3)).astype(float)
    vecs[5] = vecs[4]
    vecs[6] = -vecs[7]
    items = [(f"i{i:03d}", [float(x) for x in vecs[int(rng.integers(8))]]) for i in range(400)]
    asks = [(c, [float(x) for x in rng.integers(-2, 3, 3)]) for c in range(30)]
    seen = [(c, f"i{i:03d}") for c in range(25) for i in rng.choice(400, c % 6, replace=False)]
    return (
        spark.createDataFrame(asks, "customer_id int, vec array<double>"),
        spark.createDataFrame(items, "item_id string, vec array<double>"),
        spark.createDataFrame(seen, "customer_id int, item_id string"),
    )


def test_items_with_one_vector_are_scored_once(alike):
    asks, items, seen = alike
    kinds = Kinds.of(items, 3, 6000)
    assert kinds is not None and kinds.n < 9
    for k in (1, 4, 60):
        found = top_k_by_kind(asks, kinds, k, seen, 6000 if k == 4 else 200_000)
        assert rows(found) == rows(top_k_by_dot(asks, items, k, seen, dims=3))
    assert top_k_by_kind(asks, kinds, 60, seen, 6000) is None
    assert Kinds.of(items, 3, 100) is None and Kinds.of(items, 3) is None


def test_customer_vectors_move_numbers_of_kinds(alike):
    asks, items, seen = alike
    history = seen.withColumn("pos", F.lit(1)).groupBy("customer_id", "item_id").agg(F.max("pos").alias("pos"))
    history = history.withColumn("pos", F.expr("row_number() OVER (PARTITION BY customer_id ORDER BY item_id)"))
    want = rows(embedding.customer_vectors(history, items, 4, dims=3))
    found = embedding.customer_vectors(history, items, 4, dims=3, limit_bytes=6000)
    assert rows(found) == want
    near = rows(embedding.vector_candidates(history, items, 4, 4, dims=3, limit_bytes=6000))
    assert near == rows(embedding.vector_candidates(history, items, 4, 4, dims=3))


def test_purchase_lists_lie_in_parts_that_follow_the_input(spark, small, monkeypatch):
    from basketrank.queries import ranking

    before = rows(ranking.QUERIES["predictions_dedup"](spark, small))
    monkeypatch.setattr(staging, "BYTES_PER_PART", 5000)
    found = ranking.QUERIES["predictions_dedup"](spark, small)
    parts = staging.parts_for(found)
    assert parts > 16 and f", {parts})" in plan(found)
    assert rows(found) == before
