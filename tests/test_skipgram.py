"""Skip-gram over sharded tables: pairs, rounds and what the vectors learn."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketrank.config import EmbeddingParams
from basketrank.models import skipgram
from basketrank.operators.embedding import fit_item_vectors, purchase_sequences


@pytest.fixture(scope="module")
def planted(spark):
    """Customers buy from one of eight groups of six items, and everybody buys item "all"."""
    dice = random.Random(3)
    rows = []
    for c in range(400):
        group = c % 8
        for t in range(14):
            item = "all" if dice.random() < 0.25 else f"g{group}i{dice.randrange(6)}"
            rows.append((c, item, c * 100 + t // 4, f"2024-01-{t + 1:02d}"))
    rows += [(1, "rare", 7, "2024-02-01"), (2, None, 8, "2024-02-01"), (3, "rare", 9, "2024-02-01")]
    df = spark.createDataFrame(rows, "customer_id int, item_id string, bill_id long, updated_date string")
    return df.withColumn("updated_date", F.to_timestamp("updated_date")).repartition(5)


def close_items(vectors):
    """item -> the others by falling cosine."""
    names = sorted(vectors)
    m = np.array([vectors[n] for n in names])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return {n: [names[j] for j in np.argsort(-(m @ m[i])) if j != i] for i, n in enumerate(names)}


@pytest.mark.parametrize("shards", [1, 3])
def test_items_bought_together_are_near(spark, planted, shards):
    p = EmbeddingParams(vector_size=16, epochs=12, window=3, shards=shards)
    vectors = {r.item_id: r.vec for r in fit_item_vectors(planted, p).collect()}
    assert set(vectors) == {f"g{g}i{i}" for g in range(8) for i in range(6)} | {"all"}
    near = close_items({n: v for n, v in vectors.items() if n != "all"})
    hits = sum(x[:2] == n[:2] for n, others in near.items() for x in others[:5])
    assert hits >= 0.9 * 48 * 5


def test_same_vectors_however_rows_lie(spark, planted):
    p = EmbeddingParams(vector_size=8, epochs=2, window=2, shards=2)
    one = {r.item_id: r.vec for r in fit_item_vectors(planted, p).collect()}
    two = {r.item_id: r.vec for r in fit_item_vectors(planted.repartition(2, "item_id"), p).collect()}
    assert one == two
    other = fit_item_vectors(planted, EmbeddingParams(vector_size=8, epochs=2, window=2, shards=2, seed=1)).collect()
    assert {r.item_id: r.vec for r in other} != one


@pytest.mark.parametrize("length", [10_000, 8])
def test_every_pair_of_the_window_once(spark, planted, length):
    items, size = skipgram.vocabulary(planted, 3)
    at = {r.item_id: r.at for r in items.collect()}
    assert at["all"] == 0 and sorted(at.values()) == list(range(size))
    coded = planted.join(items.select("item_id", "at"), "item_id").drop("item_id").withColumnRenamed("at", "item_id")
    whole = {r.customer_id: r["items"] for r in purchase_sequences(coded, 10_000).collect()}
    want = Counter()
    for seq in whole.values():
        for i in range(len(seq)):
            for j in range(max(0, i - 3), i):
                want[seq[i], seq[j]] += 1
                want[seq[j], seq[i]] += 1
    found = skipgram.training_pairs(purchase_sequences(coded, length, 3), 3, 4)
    got = Counter()
    for r in found.collect():
        context_shard = (r.shard + r.round) % 4
        got[r.centre * 4 + r.shard, r.context * 4 + context_shard] += 1
    assert got == want
    assert found.select("draw").distinct().count() == found.count()


def test_a_round_holds_one_bucket_pair_and_touches_every_shard_once(spark, planted):
    items, size = skipgram.vocabulary(planted, 3)
    p = EmbeddingParams(vector_size=8, window=2)
    state = skipgram._start(items, 4, 8, 1)
    before = {(r.side, r.shard): r for r in state.collect()}
    assert len(before) == 8
    assert sum(len(r.vectors) for r in before.values()) == 2 * size * 8 * 4
    pairs = spark.createDataFrame(
        [(s, 0, 1, 1, d) for s in range(4) for d in range(50)], "shard int, centre int, context int, distance int, draw long"
    )
    after = {(r.side, r.shard): r for r in skipgram._round(state, pairs, 4, 1, 0, 0.5, 10**9, p).collect()}
    assert after.keys() == before.keys()
    for key, row in after.items():
        assert row.counts == before[key].counts and len(row.vectors) == len(before[key].vectors)
        assert row.vectors != before[key].vectors or key[0] == 0
    # Without pairs a round changes nothing.
    same = skipgram._round(state, pairs.limit(0), 4, 2, 0, 0.5, 1000, p).collect()
    assert {(r.side, r.shard): r.vectors for r in same} == {k: r.vectors for k, r in before.items()}


def test_shares_follow_distance_and_frequency():
    draw = np.random.default_rng(1).integers(-(2**62), 2**62, 200_000)
    assert taken_share(draw, 0.25) == pytest.approx(0.25, abs=0.01)
    assert (skipgram.taken(draw, 0, np.full(len(draw), 0.5)) != skipgram.taken(draw, 1, np.full(len(draw), 0.5))).any()
    shares = skipgram.keep_share(np.array([1.0, 1000.0, 300_000.0]), 1_000_000, 1e-3)
    assert shares[0] == shares[1] == 1 and shares[2] == pytest.approx((300**0.5 + 1) / 300)
    assert (skipgram.keep_share(np.array([5.0]), 10, 0) == 1).all()


def taken_share(draw, chance):
    return skipgram.taken(draw, 3, np.full(len(draw), chance)).mean()


def test_no_frequent_items(spark, planted):
    assert fit_item_vectors(planted, EmbeddingParams(min_count=10**6)).count() == 0
    assert fit_item_vectors(planted.limit(0)).count() == 0


def test_pairs_are_packed_once_in_the_order_of_their_draws(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "PACKED", 7)
    rng = np.random.default_rng(2)
    rows = [(int(r), int(s), int(c), int(x), 300 if x == 9 else 2, int(d)) for r, s, c, x, d in
            zip(*(rng.integers(0, k, 200) for k in (2, 2, 10, 10)), rng.permutation(200))]
    pairs = spark.createDataFrame(rows, "round int, shard int, centre int, context int, distance int, draw long")
    packed = skipgram._in_order(skipgram.packed_pairs(pairs, 2)).orderBy("round", "shard", "first").collect()
    got = []
    for r in packed:
        draw = np.frombuffer(r.draw, np.int64)
        assert len(draw) <= 7
        wide = np.int32 if len(r.distance) > len(draw) else np.uint8
        got += [(r.round, r.shard, int(c), int(x), int(d), int(w)) for c, x, d, w in zip(
            np.frombuffer(r.centre, np.int32), np.frombuffer(r.context, np.int32), np.frombuffer(r.distance, wide), draw)]
    assert got == sorted(rows, key=lambda t: (t[0], t[1], t[5]))
    assert len(packed) <= 4 * 2 + 200 // 7


def test_rows_add_up_at_repeated_places():
    rng = np.random.default_rng(4)
    table, at, rows = np.zeros((9, 3), np.float32), rng.integers(0, 9, 50), rng.integers(-4, 5, (50, 3)).astype(np.float32)
    want = table.copy()
    np.add.at(want, at, rows)
    skipgram._add(table, at, rows)
    assert (table == want).all()


def test_tables_of_a_small_vocabulary_give_the_same_update(monkeypatch):
    rng = np.random.default_rng(5)
    centres, contexts = (rng.normal(size=(n, 8)).astype(np.float32) for n in (12, 9))
    centre, context = rng.integers(0, 12, 60), rng.integers(0, 9, 60)
    found = []
    for cells in (0, 10**9):
        monkeypatch.setattr(skipgram, "_CELLS_A_TARGET", cells)
        bucket = skipgram.Bucket(centres.copy(), contexts.copy(), (np.ones(12), np.arange(1.0, 10)), 5, [1, 2])
        bucket._update(centre, context, np.float32(0.05))
        found.append((bucket.centres, bucket.contexts))
    for a, b, old in zip(*found, (centres, contexts)):
        assert np.abs(a - b).max() < 1e-5 < np.abs(a - old).max()


def test_a_large_bucket_is_trained_in_pieces(spark, planted, monkeypatch):
    p = EmbeddingParams(vector_size=16, epochs=45, window=3, shards=1)
    monkeypatch.setattr(skipgram, "PIECE", 15_000)
    assert skipgram.pieces_for(5600, 3, 1) == 3 and skipgram.pieces_for(5600, 3, 2) == skipgram.pieces_for(5600, 3, 1, 200) == 1
    found = [{r.item_id: r.vec for r in fit_item_vectors(df, p).collect()} for df in (planted, planted.repartition(2))]
    assert found[0] == found[1] and len(found[0]) == 49
    near = close_items({n: v for n, v in found[0].items() if n != "all"})
    hits = sum(x[:2] == n[:2] for n, others in near.items() for x in others[:5])
    assert hits >= 0.9 * 48 * 5
