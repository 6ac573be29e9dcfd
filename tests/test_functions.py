"""Joins, ranks, samples and vector products against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from basketrank.functions import joins, vectors
from basketrank.functions.joins import add_by_pair, fits_broadcast, heavy_keys, lookup, salted_join
from basketrank.functions.ordering import dense_index, hash_take, top_n
from basketrank.functions.staging import new_path, release, shared_folder, stage
from basketrank.functions.vectors import top_k_by_dot


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, some have none."""
    rng = random.Random(3)
    data = []
    for n in range(3000):
        key = "hot" if n % 3 == 0 else None if n % 50 == 1 else f"k{rng.randrange(40)}"
        data.append((n, key))
    keys = ["hot", "lonely"] + [f"k{i}" for i in range(0, 40, 2)]
    return (
        spark.createDataFrame(data, "n int, key string"),
        spark.createDataFrame([(k, k.upper()) for k in keys], "key string, name string"),
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_returns_what_the_broadcast_returns(skewed, how):
    fact, dim = skewed
    small = lookup(fact, dim, "key", how)
    large = lookup(fact, dim, "key", how, limit_bytes=0, spread="n")
    assert "BroadcastHashJoin" in plan(small)
    assert large.columns == small.columns
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, large.collect())) == sorted(map(key, small.collect()))


def test_salted_join_splits_the_hot_key(spark, skewed):
    fact, dim = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(fact, dim, "key", limit_bytes=0, spread="n")
        sizes = joined.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1
    assert sum(r["count"] for r in sizes) == 1000


def test_heavy_keys_come_from_one_column_and_nothing_is_written(spark, tmp_path):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [1] * 30_000 + [2] * 4_000 + list(range(3, 56_003)) + [None] * 10_000
    fact = spark.createDataFrame([(k, "wide" * 5) for k in keys], "key long, text string").repartition(9)
    found = dict(heavy_keys(fact, "key"))
    # 90,000 rows with a key, of which a quarter share is 90,000 / (4 * parts).
    quarter = 90_000 / (4 * parts)
    assert set(found) == {1, 2}
    assert 30_000 / quarter <= found[1] <= 30_000 / quarter + 2
    assert 4_000 / quarter <= found[2] <= 4_000 / quarter + 2
    assert heavy_keys(fact.filter("key > 2"), "key") == []
    assert heavy_keys(fact.filter("key IS NULL"), "key") == []
    staged = []
    patch = pytest.MonkeyPatch()
    patch.setattr(joins, "stage", lambda df, label: staged.append(label) or df)
    salted_join(fact, spark.createDataFrame([(1, "a")], "key long, name string"), "key").count()
    patch.undo()
    assert staged == []


def largest_share(df) -> float:
    """Rows of the largest task against the mean of all tasks."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) / sum(sizes)


def test_no_task_of_a_salted_join_is_large(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.range(60_000).select(
            F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, 8).otherwise(F.col("id")).alias("key"), "id"
        )
        dim = fact.select("key").distinct()
        assert largest_share(salted_join(fact, dim, "key", "left_semi", "id")) < 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("fits", [True, False])
def test_pairs_of_a_heavy_customer_are_cut_where_they_lie(spark, fits):
    left = spark.createDataFrame(
        [(c, f"i{n}", 1.0) for c in range(40) for n in range(c, c + 5)] + [(None, "i1", 2.0)],
        "customer_id int, item_id string, score double",
    )
    pairs = [(3, f"i{n}") for n in range(4000)] + [(c, f"i{n}") for c in range(60) if c != 3 for n in range(20)]
    right = spark.createDataFrame([(*p, 1) for p in pairs], "customer_id int, item_id string, n int")
    patch = pytest.MonkeyPatch()
    if not fits:
        patch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    kept = joins._without_surplus(left, right, right)
    patch.undo()
    assert kept.filter("customer_id = 3").count() == 5
    assert kept.filter("customer_id <> 3").count() == 59 * 20
    got = rows(add_by_pair(left.filter("customer_id IS NOT NULL"), right), "customer_id", "item_id", "n")
    bought = set(pairs)
    want = sorted((c, f"i{n}", 1 if (c, f"i{n}") in bought else None) for c in range(40) for n in range(c, c + 5))
    assert got == want


def test_fits_broadcast_counts_rows(skewed):
    _, dim = skewed
    assert fits_broadcast(dim, 10, 220)
    assert not fits_broadcast(dim, 10, 219)


def test_dense_index_equals_a_sort(spark):
    rng = random.Random(1)
    data = [(rng.randrange(20), f"i{n}") for n in range(500)]
    df = spark.createDataFrame(data, "n int, item string")
    got = dense_index(df, [F.col("n").desc(), F.col("item")], "at").collect()
    want = {item: at for at, (_, item) in enumerate(sorted(data, key=lambda r: (-r[0], r[1])))}
    assert {r["item"]: r["at"] for r in got} == want


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.range(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_hash_take_is_exact_and_repeatable(spark, n):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    first = rows(hash_take(df, ["k"], n, seed=5))
    assert len(first) == min(n, 500)
    assert first == rows(hash_take(df.repartition(7), ["k"], n, seed=5))


def test_hash_take_grows_with_n_and_changes_with_the_seed(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    ten, twenty = (set(rows(hash_take(df, ["k"], n))) for n in (10, 20))
    assert ten < twenty
    assert set(rows(hash_take(df, ["k"], 20, seed=1))) != twenty


def test_top_n_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    cut = top_n(df, "g", [F.col("id").desc()], 2)
    assert "WindowGroupLimit" in plan(cut)
    assert rows(cut, "g", "id", "pos") == [
        (0, 96, 2), (0, 99, 1), (1, 94, 2), (1, 97, 1), (2, 95, 2), (2, 98, 1),
    ]


def _brute(customers, items, seen, k):
    out = []
    for c, v in customers.items():
        scores = [
            (-round(float(np.dot(v, w)), 9), i) for i, w in items.items() if (c, i) not in seen
        ]
        for pos, (score, i) in enumerate(sorted(scores)[:k], start=1):
            out.append((c, pos, i, -score + 0.0))
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 100])
@pytest.mark.parametrize("masked", [True, False])
def test_top_k_by_dot_both_ways(spark, k, masked):
    rng = np.random.default_rng(4)
    # Small whole numbers make many ties.
    customers = {c: rng.integers(-1, 2, 3).astype(float) for c in range(30)}
    items = {f"i{n:02d}": rng.integers(-1, 2, 3).astype(float) for n in range(40)}
    seen = {(c, f"i{n:02d}") for c in range(30) for n in range(40) if rng.random() < 0.2 or c == 7}
    seen |= {(3, "unknown item")}
    queries = spark.createDataFrame(
        [(c, v.tolist()) for c, v in customers.items()], "customer_id int, vec array<double>"
    )
    catalogue = spark.createDataFrame(
        [(i, v.tolist()) for i, v in items.items()], "item_id string, vec array<double>"
    )
    pairs = spark.createDataFrame(sorted(seen), "customer_id int, item_id string")
    want = _brute(customers, items, seen if masked else set(), k)
    mask = pairs if masked else None
    columns = ("customer_id", "pos", "item_id", "score")
    assert rows(top_k_by_dot(queries, catalogue, k, mask, dims=3), *columns) == want
    blocks = top_k_by_dot(
        queries, catalogue, k, mask, dims=3,
        limit_bytes=0, customers_per_block=7, items_per_block=9,
    )
    assert rows(blocks, *columns) == want


def test_blocks_copy_no_customer_and_return_final_lists(spark):
    rng = np.random.default_rng(6)
    queries = spark.createDataFrame(
        [(c, rng.normal(size=4).tolist()) for c in range(50)], "customer_id int, vec array<double>"
    ).repartition(5)
    items = spark.createDataFrame(
        [(f"i{n}", rng.normal(size=4).tolist()) for n in range(300)], "item_id string, vec array<double>"
    )
    schema = "customer_id int, item_id string, score double"
    scored = vectors._scored_by_blocks(queries, items, 7, None, schema, 8, 32)
    # Seven rows of each customer leave the tasks, before anything is ranked.
    assert scored.count() == 50 * 7
    steps = plan(scored)
    assert "Generate" not in steps and "CoGroup" not in steps
    # The one shuffle is the repartition above.
    assert steps.count("Exchange") == 1
    # What a task holds is cut to its k best per customer.
    best = vectors._RunningBest(rng.normal(size=(20, 4)), [None] * 20, 3)
    for lo in range(0, 2000, 50):
        best.add(np.arange(lo, lo + 50), rng.normal(size=(50, 4)))
        assert len(best.rows) <= 60 and best.n_found <= 60
    best.cut()
    assert np.bincount(best.rows).tolist() == [3] * 20


def test_top_k_without_items(spark):
    queries = spark.createDataFrame([(1, [1.0])], "customer_id int, vec array<double>")
    empty = spark.createDataFrame([], "item_id string, vec array<double>")
    assert top_k_by_dot(queries, empty, 3, dims=1).count() == 0


def test_staged_table_lies_in_the_shared_folder(spark):
    assert new_path(spark, "x").startswith(shared_folder(spark))
    staged = stage(spark.range(5), "five")
    assert staged.count() == 5
    assert "Scan parquet" in plan(staged) or "FileScan" in plan(staged)


def test_release_removes_what_was_staged(spark):
    import os

    path = stage(spark.range(5), "gone").inputFiles()[0].replace("file://", "")
    assert os.path.exists(path)
    release(spark)
    assert not os.path.exists(path)
