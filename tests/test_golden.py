"""Hand-worked values."""

import golden
import pytest
from conftest import rows
from pyspark.sql import functions as F

from basketrank.operators import covisit, evaluate
from basketrank.operators.history import history_candidates
from basketrank.operators.item_features import item_features, label_encode
from basketrank.operators.user_features import user_features


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-6)


def test_user_features(spark):
    got = rows(
        user_features(golden.transactions(spark)),
        "customer_id", "u_n_transactions", "u_n_unique_items", "u_n_unique_bills",
        "u_total_quantity", "u_total_spend", "u_avg_price", "u_avg_discount", "u_n_days_active",
        "u_days_since_last", "u_span_days", "u_purchase_freq", "u_avg_bill_size", "u_is_new_user",
        "u_purchases_last_30d", "u_purchases_last_60d", "u_purchases_last_90d",
    )
    near(
        got,
        [
            (1, 3, 2, 2, 4, 30, 8.333333, 0.333333, 2, 0, 299, 0.01, 15, 0, 1, 1, 1),
            (2, 3, 3, 2, 5, 21, 5.666667, 0, 1, 30, 0, 3, 10.5, 1, 2, 3, 3),
            (3, 1, 1, 1, 1, 2, 2, 0, 1, 244, 0, 1, 2, 1, 0, 0, 0),
        ],
    )


def test_month_counts(spark):
    got = rows(
        user_features(golden.transactions(spark)),
        "customer_id", "u_month_1_count", "u_month_3_count", "u_month_10_count",
    )
    assert got == [(1, 2, 0, 1), (2, 0, 0, 3), (3, 0, 1, 0)]


def test_item_features(spark):
    got = rows(
        item_features(golden.transactions(spark), golden.items(spark)),
        "item_id", "i_n_purchases", "i_n_unique_buyers", "i_n_bills", "i_total_quantity",
        "i_popularity_rank", "i_buyer_diversity", "i_is_popular", "i_purchase_last_30d",
        "i_trend_score",
    )
    want = [
        ("A", 3, 2, 3, 3, 1, 0.5, 1, 2, 1.537275),
        ("B", 2, 2, 2, 3, 2, 0.666667, 0, 0, 0),
        ("C", 2, 2, 2, 4, 3, 0.666667, 0, 1, 0.832869),
    ]
    assert [r[0] for r in got] == [r[0] for r in want]
    near([r[1:] for r in got], [r[1:] for r in want])


def test_null_category_takes_a_place_but_gets_no_code(spark):
    got = rows(
        label_encode(golden.items(spark)), "item_id", "category_l1_enc", "category_l2_enc",
        "brand_enc",
    )
    assert got == [("A", 0, None, 1), ("B", 1, 2, 0), ("C", 0, 1, 1)]


def test_history(spark):
    got = rows(history_candidates(golden.transactions(spark)), "customer_id", "pos", "item_id")
    assert got == [(1, 1, "A"), (1, 2, "B"), (2, 1, "A"), (2, 2, "C"), (2, 3, "B"), (3, 1, "C")]


def test_covisit(spark):
    tx = golden.transactions(spark)
    near_items = covisit.covisit_neighbours(tx)
    assert rows(near_items, "item_id", "co_item_id", "score") == [
        ("A", "B", 1), ("A", "C", 1), ("B", "A", 1), ("C", "A", 1),
    ]
    found = covisit.covisit_candidates(history_candidates(tx), near_items)
    assert rows(found, "customer_id", "item_id", "score") == [(1, "C", 1), (3, "A", 1)]


@pytest.fixture(scope="module")
def lists(spark):
    data = [(1, "A", 1), (1, "B", 2), (1, "C", 3), (2, "D", 1), (3, "E", 1), (3, "A", 2)]
    truth = [(1, "A"), (1, "C"), (2, "X"), (4, "A")]
    return (
        spark.createDataFrame(data, "customer_id int, item_id string, pos int"),
        spark.createDataFrame(truth, "customer_id int, item_id string"),
    )


def test_metrics_at_10(lists):
    row = evaluate.evaluate(*lists, k=10).first().asDict()
    want = {
        "recall@10": 0.5,
        "precision@10": 0.5,
        "ndcg@10": 0.459860,
        "hit_rate@10": 0.333333,
        "n_users_predicted": 3,
        "n_users_in_gt": 2,
        "total_correct_recommendations": 2,
        "precision_at_10": 0.5,
        "map": 0.416667,
        "iou": 0.333333,
        "reciprocal_rank_first_hit": 0.5,
    }
    assert row == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_plain_precision_at_5(lists):
    row = evaluate.evaluate(*lists, k=5).first().asDict()
    assert row["precision@5"] == pytest.approx(0.2)
    assert row["precision_at_10"] == pytest.approx(0.5)


def test_empty_lists_count_in_the_hit_rate_only_when_named(spark, lists):
    predictions, truth = lists
    named = spark.createDataFrame([(1,), (2,), (3,), (4,)], "customer_id int")
    row = evaluate.evaluate(predictions, truth, 10, named).first().asDict()
    assert row["hit_rate@10"] == pytest.approx(0.25)
    assert row["n_users_predicted"] == 4 and row["n_users_in_gt"] == 3
    assert row["recall@10"] == pytest.approx(1 / 3)


def test_no_predictions_give_zeros(lists):
    predictions, truth = lists
    row = evaluate.evaluate(predictions.filter(F.lit(False)), truth).first().asDict()
    assert set(row.values()) == {0}


def test_truth_as_prediction_has_full_recall(lists):
    _, truth = lists
    ranked = evaluate.unique_keep_order(truth.withColumn("pos", F.hash("item_id")))
    row = evaluate.evaluate(ranked, truth).first().asDict()
    assert row["recall@10"] == row["ndcg@10"] == row["map"] == row["iou"] == 1.0
