"""Properties of operators on the star schema and on small made-up lists."""

from __future__ import annotations

import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from basketrank import config
from basketrank.functions.staging import new_path, stage
from basketrank.models.popularity import PopularityModel
from basketrank.operators import covisit, matrix, split
from basketrank.operators.candidates import merge_candidates
from basketrank.operators.embedding import customer_vectors, purchase_sequences
from basketrank.operators.interactions import interactions
from basketrank.operators.user_features import user_features
from basketrank.queries.common import Case
from basketrank.schema import EVENTS, ITEMS, conform, require_unique
from basketrank.sources import sinks
from basketrank.sources.tables import read_transactions, write_by_month


@pytest.fixture(scope="module")
def case(spark, small):
    return Case(spark, small)


def test_split_with_year_reaches_the_scan(case):
    taken = split.take(case.tx, "updated_date", (split.TRAIN,), split.SplitRule(year=2000))
    assert "GreaterThanOrEqual(o_orderdate" in plan(taken)


def test_month_folders_are_pruned(spark, case):
    path = new_path(spark, "by-month")
    write_by_month(case.tx, path, "updated_date", "bill_id", "item_id")
    table = read_transactions(spark, path)
    for rule in (split.SplitRule(), split.SplitRule(year=2000)):
        taken = split.take(table, "updated_date", (split.VAL,), rule)
        filters = plan(taken).split("PartitionFilters: [")[1].split("]")[0]
        assert "part_month" in filters
        want = split.take(case.tx, "updated_date", (split.VAL,), rule)
        assert taken.count() == want.count() > 0


def test_history_windows_nest(case):
    sizes = [split.history_for(case.tx, t).count() for t in ("val", "test", "jan2026")]
    assert sizes[0] < sizes[1] < sizes[2] == case.tx.count()


def test_conform_names_missing_columns(spark):
    with pytest.raises(ValueError, match="sale_status"):
        conform(spark.createDataFrame([("a",)], "item_id string"), ITEMS)


def test_require_unique(spark):
    with pytest.raises(ValueError, match="repeats"):
        require_unique(spark.createDataFrame([("a",), ("a",)], "item_id string"), "item_id")


def test_event_weights(spark):
    kinds = ["purchase", "add_to_cart", "wishlist", "view", "click", None]
    data = [(1, f"i{n}", kind, None) for n, kind in enumerate(kinds)]
    none = spark.createDataFrame([], "customer_id int, item_id string, quantity int")
    pairs = interactions(none, spark.createDataFrame(data, EVENTS))
    got = {r["item_id"]: float(r["weight"]) for r in pairs.collect()}
    assert got == {f"i{n}": config.EVENT_WEIGHTS[kind] for n, kind in enumerate(kinds[:4])}


def test_neighbours_are_symmetric_without_a_limit(case):
    near = covisit.covisit_neighbours(case.train, per_item=10_000)
    there = near.select("item_id", "co_item_id", "score")
    back = near.select("co_item_id", "item_id", "score")
    assert there.exceptAll(back).count() == 0
    assert near.filter("item_id = co_item_id OR score <= 0").count() == 0


def test_candidates(case):
    found = stage(case.candidates(), "candidates")
    assert found.groupBy("customer_id", "item_id").count().filter("count > 1").count() == 0
    assert found.join(case.active, "item_id", "left_anti").count() == 0
    assert found.filter("from_history + from_covisit + from_w2v = 0").count() == 0
    assert found.filter("from_history = 1 AND from_covisit + from_w2v > 0").count() == 0


def test_covisit_candidates_with_and_without_broadcast(case):
    history, near = stage(case.history(), "history"), stage(case.neighbours(), "near")
    small = covisit.covisit_candidates(history, near, 5)
    large = covisit.covisit_candidates(history, near, 5, limit_bytes=0)
    assert rows(small) == rows(large)


def test_customer_vectors_with_and_without_broadcast(case):
    history = stage(case.history(), "history")
    small = customer_vectors(history, case.vectors)
    large = customer_vectors(history, case.vectors, limit_bytes=0)
    a, b = (dict(df.collect()) for df in (small, large))
    assert a.keys() == b.keys()
    assert all(a[c] == pytest.approx(b[c]) for c in a)
    assert all(sum(x * x for x in v) == pytest.approx(1.0) for v in a.values())


def test_merge_keeps_the_first_source(spark):
    table = "customer_id int, item_id string, pos int, score double"
    history = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 2, 0.0)], table)
    together = spark.createDataFrame([(1, "c", 1, 9.0), (1, "d", 2, 3.0)], table)
    near = spark.createDataFrame([(1, "d", 1, 0.9), (1, "e", 2, 0.8), (2, "e", 1, 0.7)], table)
    merged = merge_candidates(history, together, near, total=5)
    columns = ("customer_id", "pos", "item_id", "from_history", "from_covisit", "from_w2v")
    assert rows(merged, *columns) == [
        (1, 1, "a", 1, 0, 0), (1, 2, "b", 1, 0, 0), (1, 3, "c", 0, 1, 0), (1, 4, "d", 0, 1, 1),
        (1, 5, "e", 0, 0, 1), (2, 1, "e", 0, 0, 1),
    ]
    assert merge_candidates(history, together, near, total=2).count() == 3


def test_long_histories_continue_in_chunks(case):
    whole = {r["customer_id"]: r["items"] for r in purchase_sequences(case.train).collect()}
    cut = purchase_sequences(case.train, 7).orderBy("customer_id", "chunk").collect()
    glued: dict[int, list[str]] = {}
    for r in cut:
        assert len(r["items"]) <= 7
        glued.setdefault(r["customer_id"], []).extend(r["items"])
    assert glued == whole


def test_user_features_read_the_history_twice(case):
    text = plan(user_features(case.train))
    assert text.count("FileScan parquet") <= 6  # three tables: the aggregate and its last date


@pytest.mark.parametrize("limit", [None, 0])
def test_popularity_against_a_plain_loop(spark, limit):
    rng = random.Random(2)
    items = [f"i{n:02d}" for n in range(25)]
    pairs = {(c, i): rng.randrange(1, 5) for c in range(20) for i in items if rng.random() < 0.4}
    pairs |= {(99, i): 1 for i in items}  # has seen everything
    table = spark.createDataFrame(
        [(c, i, w) for (c, i), w in pairs.items()], "customer_id int, item_id string, weight int"
    )
    customers = spark.createDataFrame([(c,) for c in [*range(20), 99, 500]], "customer_id int")
    totals = {i: sum(w for (_, j), w in pairs.items() if j == i) for i in items}
    order = sorted(items, key=lambda i: (-totals[i], i))
    for k in (1, 10, 40):
        got = PopularityModel.fit(table).recommend(customers, k, table, limit_bytes=limit)
        want = [
            (c, pos, i)
            for c in [*range(20), 99, 500]
            for pos, i in enumerate([i for i in order if (c, i) not in pairs][:k], start=1)
        ]
        assert rows(got, "customer_id", "pos", "item_id") == want


def test_labels_may_fan_out(spark):
    candidates = spark.createDataFrame([(1, "a"), (1, "b")], "customer_id int, item_id string")
    bought = spark.createDataFrame([(1, "a"), (1, "a")], "customer_id int, item_id string")
    assert rows(matrix.label_candidates(candidates, bought)) == [(1, "a", 1), (1, "b", 0)]
    assert matrix.label_candidates(candidates, bought, False).count() == 3


def test_negatives_per_positive(spark):
    df = spark.range(1000).select(
        F.col("id").cast("int").alias("customer_id"),
        F.lit("a").alias("item_id"),
        (F.col("id") < 30).cast("int").alias("label"),
    )
    for ratio, want in ((0, 0), (4, 120), (50, 970)):
        kept = matrix.sample_pairs(df, ratio)
        assert kept.filter("label = 1").count() == 30
        assert kept.filter("label = 0").count() == want


def test_feature_matrix_with_and_without_broadcast(case):
    from basketrank.operators.item_features import item_features

    found = stage(case.candidates(), "candidates")
    users, items = user_features(case.train), stage(item_features(case.train, case.items), "items")
    a, b = (
        matrix.feature_matrix(found, case.train, users, items, case.val, limit_bytes=limit)
        for limit in (None, 0)
    )
    assert len(matrix.feature_columns(a)) == 53
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == found.count()


def test_resumed_run_adds_only_what_is_missing(spark):
    path = new_path(spark, "resumable")
    customers = spark.range(40).select(F.col("id").cast("int").alias("customer_id"))

    def predict(part, bucket, item="x"):
        # Customers divisible by 5 have no predictions.
        return part.filter("customer_id % 5 <> 0").select(
            "customer_id", F.lit(item).alias("item_id"), F.lit(1).alias("pos")
        )

    calls = []

    def breaks(part, bucket):
        calls.append(bucket)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return predict(part, bucket)

    def lists():
        return {r["customer_id"]: r["items"] for r in sinks.read_lists(spark, path).collect()}

    def want(item):
        return {str(c): [] if c % 5 == 0 else [item] for c in range(40)}

    with pytest.raises(RuntimeError):
        sinks.write_resumable(customers, breaks, path, buckets=4, tag="a")
    done = sinks.finished_customers(spark, sinks.partial_path(path, "a"))
    partly = {r["customer_id"] for r in done.collect()}
    assert 0 < len(partly) < 40
    # Only the customers that are missing are predicted again.
    sinks.write_resumable(customers, lambda p, b: predict(p, b, "y"), path, buckets=4, tag="a")
    mixed = lists()
    assert {c for c, items in mixed.items() if items == ["x"]} == {str(c) for c in partly if c % 5}
    assert len(mixed) == 40
    # A run after a finished one predicts everybody again.
    sinks.write_resumable(customers, lambda p, b: predict(p, b, "z"), path, buckets=4, tag="a")
    assert lists() == want("z")
    # What another model left unfinished is not used.
    calls.clear()
    with pytest.raises(RuntimeError):
        sinks.write_resumable(customers, breaks, path, buckets=4, tag="a")
    assert lists() == want("z")
    sinks.write_resumable(customers, lambda p, b: predict(p, b, "w"), path, buckets=4, tag="b")
    assert lists() == want("w")


def test_no_query_pairs_everything(spark, small):
    from basketrank.queries import QUERIES, models

    for name, query in QUERIES.items():
        if name not in models.QUERIES:
            text = plan(query(spark, small))
            assert "CartesianProduct" not in text, name
            assert "BroadcastNestedLoopJoin" not in text, name
