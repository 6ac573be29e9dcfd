"""Whole runs on the smallest data, from Parquet files in logical form."""

from __future__ import annotations

import json

import pytest

from basketrank.config import AlsParams, CandidateLimits, EmbeddingParams, RankerParams
from basketrank.jobs import prepare, profile, single_stage, two_stage
from basketrank.jobs.common import Places
from basketrank.models.als import AlsRecommender
from basketrank.models.ranker import PairRanker
from basketrank.operators import split
from basketrank.sources.sinks import read_lists
from basketrank.sources.star import open_star
from basketrank.sources.tables import open_tables, write_by_month

SETTINGS = two_stage.Settings(
    limits=CandidateLimits(history=30, covisit=30, vectors=30),
    embedding=EmbeddingParams(vector_size=8, epochs=1, shards=2),
    ranker=RankerParams(trees=3, max_depth=3, train_users=60),
)


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    star = open_star(spark, small)
    write_by_month(star.transactions, f"{folder}/tx", "updated_date", "bill_id", "item_id")
    star.items.write.parquet(f"{folder}/items")
    star.events.write.parquet(f"{folder}/events")
    return open_tables(spark, f"{folder}/tx", f"{folder}/items", f"{folder}/events")


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return Places(str(tmp_path_factory.mktemp("out")))


def _seen_pairs(spark, out, model):
    return spark.read.parquet(out.model(f"{model}_interactions")).select("customer_id", "item_id")


@pytest.mark.parametrize("model", ["popularity", "als"])
@pytest.mark.parametrize("use_events", [False, True])
def test_single_stage(spark, tables, out, model, use_events):
    als = AlsParams(factors=4, iterations=2)
    metrics = single_stage.train(
        spark, tables, out, model, use_events, als=als, event_year=2024
    ).first()
    assert 0 < metrics["recall@10"] <= 1
    assert metrics["n_users_predicted"] == metrics["n_users_in_gt"]
    lists = single_stage.predict(spark, tables, out, model)
    assert lists.count() > 50
    from basketrank.sources.sinks import ranked_rows

    rows = ranked_rows(read_lists(spark, out.predictions("predictions_test")))
    assert rows.count() == 10 * lists.count()
    assert rows.join(_seen_pairs(spark, out, model), ["customer_id", "item_id"], "left_semi").count() == 0


def test_events_widen_what_is_excluded(spark, tables, out):
    single_stage.train(
        spark, tables, out, "popularity", True, event_year=2024, evaluate_model=False
    )
    pairs = _seen_pairs(spark, out, "popularity")
    bought = single_stage._seen(pairs, tables, split.SplitRule(), "purchases")
    assert pairs.count() > bought.count()


def test_als_skips_unknown_customers(spark, tables, out):
    single_stage.train(
        spark, tables, out, "als", als=AlsParams(factors=4, iterations=2), evaluate_model=False
    )
    model = AlsRecommender.load(spark, out.model("als"))
    customers = spark.createDataFrame([(1,), (987654,)], "customer_id int")
    assert {r["customer_id"] for r in model.recommend(customers, 3).collect()} <= {1}


@pytest.fixture(scope="module")
def trained(spark, tables, out):
    return two_stage.train(spark, tables, out, SETTINGS).first()


def test_two_stage_training(spark, out, trained):
    assert 0 < trained["recall@10"] <= 1
    importance = spark.read.json(out.report("importance"))
    assert importance.count() == 53
    assert importance.agg({"importance": "sum"}).first()[0] == pytest.approx(1.0)
    vectors = spark.read.parquet(out.model("vectors"))
    assert vectors.count() > 50 and len(vectors.first()["vec"]) == 8


def test_training_on_all_pairs_of_all_customers(spark, tables, out, trained, monkeypatch):
    from dataclasses import replace

    from basketrank.operators.split import customers_of, take
    from basketrank.queries import runs

    settings = replace(SETTINGS, ranker=replace(runs._WHOLE.ranker, trees=1, max_depth=1))
    fit, given = PairRanker.fit, []
    monkeypatch.setattr(two_stage.PairRanker, "fit", lambda pairs, params: given.append(pairs) or fit(pairs, params))
    two_stage.train(spark, tables, out, settings, skip_sources=True, evaluate_model=False)
    (pairs,) = given
    assert pairs.select("customer_id").distinct().count() == customers_of(take(tables.transactions, "updated_date")).count()
    counts = {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()}
    assert counts[0] > 25 * counts[1] or counts[0] + counts[1] > 60 * 21
    two_stage.train(spark, tables, out, replace(SETTINGS), skip_sources=True, evaluate_model=False)


def test_two_stage_training_again_without_sources(spark, tables, out, trained):
    again = two_stage.train(spark, tables, out, SETTINGS, skip_sources=True, held_out=True)
    assert again.first()["n_users_predicted"] > 0


def test_two_stage_prediction(spark, tables, out, trained):
    metrics = two_stage.predict(
        spark, tables, out, split.VAL, SETTINGS, buckets=2, quick_metrics=True
    ).first()
    lists = read_lists(spark, out.predictions("predictions_two_stage_val")).collect()
    wanted = split.customers_of(split.target_rows(tables.transactions, split.VAL)).count()
    assert len(lists) == len({r["customer_id"] for r in lists}) == wanted
    assert metrics["n_users_predicted"] == wanted
    assert all(len(set(r["items"])) == len(r["items"]) <= 10 for r in lists)


def test_two_stage_prediction_of_some_customers(spark, tables, out, trained):
    two_stage.predict(spark, tables, out, "jan2026", SETTINGS, max_customers=5)
    path = out.predictions("predictions_two_stage_jan2026_5")
    assert read_lists(spark, path).count() == 5


def test_final_training_and_no_vectors(spark, tables, tmp_path):
    from dataclasses import replace

    settings = replace(SETTINGS, vectors=False)
    place = Places(str(tmp_path))
    assert two_stage.train(spark, tables, place, settings, final=True) is None
    ranker = PairRanker.load(place.model("ranker"))
    assert "ui_w2v_score" in ranker.features
    # Prediction falls back to two sources, with or without being told.
    for wanted in (settings, SETTINGS):
        two_stage.predict(spark, tables, place, "jan2026", wanted, max_customers=5)
        assert read_lists(spark, place.predictions("predictions_two_stage_jan2026_5")).count() == 5


def test_prediction_with_a_new_model_replaces_the_lists(spark, tables, tmp_path):
    from dataclasses import replace

    place = Places(str(tmp_path))
    path = place.predictions("predictions_two_stage_val_20")
    found = []
    for settings in (SETTINGS, replace(SETTINGS, ranker=RankerParams(trees=1, max_depth=1, train_users=40, seed=7))):
        two_stage.train(spark, tables, place, settings, bool(found), evaluate_model=False)
        two_stage.predict(spark, tables, place, split.VAL, settings, max_customers=20)
        lists = {r["customer_id"]: r["items"] for r in read_lists(spark, path).collect()}
        assert len(lists) == 20
        found.append(lists)
    assert found[0] != found[1]


def test_shards_and_blocks_follow_the_rows(spark, small):
    from basketrank.models import als
    from basketrank.models.skipgram import LEAST_ITEMS, MOST_ITEMS, shards_for

    rows = spark.range(1000)
    cores = spark.sparkContext.defaultParallelism
    assert als.blocks_for(rows, 10) == 100
    assert als.blocks_for(rows, 1000) == cores
    assert shards_for(100, 8) == 1
    assert shards_for(3 * LEAST_ITEMS, 8) == 3
    assert shards_for(100 * LEAST_ITEMS, 8) == 8
    assert shards_for(100 * MOST_ITEMS, 8) == 100
    assert shards_for(100, 8, 5) == 5


def test_registered_ranker_has_all_default_trees(spark, small):
    from basketrank.queries.models import _ranker

    trees = _ranker(spark, small)[0].model.trees
    assert trees["tree"].nunique() == RankerParams().trees
    assert (trees[trees["feature_at"] < 0].groupby("tree").size() <= RankerParams().leaves).all()


def test_ranker_finds_a_planted_signal(spark):
    df = spark.range(400).selectExpr(
        "cast(id AS int) AS customer_id", "'a' AS item_id", "cast(id % 7 AS double) AS noise",
        "cast(id % 10 AS double) AS signal", "cast(id % 10 > 6 AS int) AS label",
    )
    ranker = PairRanker.fit(df, RankerParams(trees=3, max_depth=2))
    assert ranker.auc(df) > 0.9
    assert ranker.importance().first()["feature"] == "signal"
    assert ranker.rank(df.limit(0)).count() == 0


def test_vector_vocabulary_is_the_frequent_items(spark, small):
    from basketrank.operators.embedding import fit_item_vectors
    from basketrank.queries.common import Case

    train = Case(spark, small).train
    params = EmbeddingParams(vector_size=4, epochs=1, shards=3, min_count=40)
    known = {r["item_id"] for r in fit_item_vectors(train, params).collect()}
    frequent = train.groupBy("item_id").count().filter("count >= 40").collect()
    assert known == {r["item_id"] for r in frequent}


def test_prepared_tables_are_pruned_by_month(spark, tables, tmp_path):
    from conftest import plan

    prepare.run(spark, tables, Places(str(tmp_path)))
    tables.items.write.parquet(f"{tmp_path}/items")
    stored = open_tables(spark, f"{tmp_path}/transactions", f"{tmp_path}/items", f"{tmp_path}/events")
    assert stored.transactions.count() == tables.transactions.count()
    rule = split.SplitRule(year=2000)
    labelled = plan(split.with_part(stored.transactions, "updated_date", rule))
    assert "part_year" in labelled.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_split_filters_reach_the_scan(spark, small):
    from conftest import plan

    tx = open_star(spark, small).transactions
    text = plan(split.with_part(tx, "updated_date", split.SplitRule(year=2000)))
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in text
    text = plan(split.by_target(tx).groupBy("target", "role").count())
    assert text.count("lineitem.parquet") == 1


def test_profile(spark, tables, out):
    profile.run(spark, tables, out, event_year=2024)
    row = spark.read.json(out.report("profile/split")).filter("split = 'train'").first()
    assert row["n_rows"] > 0 and 0 < row["pct"] < 100
    truth = read_lists(spark, out.predictions("ground_truth_test")).collect()
    assert all(r["items"] == sorted(set(r["items"])) for r in truth)
    json.dumps([r.asDict() for r in truth])
