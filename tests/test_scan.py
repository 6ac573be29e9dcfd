"""Running values of long groups, cut into segments, against one window per group."""

from __future__ import annotations

import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from basketrank.functions import scan
from basketrank.functions.scan import is_long, running


@pytest.fixture(scope="module")
def groups(spark):
    """One group has a third of all rows and starts late; places have gaps."""
    dice = random.Random(2)
    data = []
    for g in range(60):
        places = dice.sample(range(1500), 500 if g == 0 else dice.randrange(1, 30))
        data += [(g, 700 + p if g == 0 else p, dice.randrange(5)) for p in places]
    return spark.createDataFrame(data, "g int, pos int, x int").repartition(6)


@pytest.mark.parametrize("width", [1, 13, 100, 5000])
def test_segments_equal_one_window(groups, width):
    options = {"number": "n", "sums": {"total": "x", "twice": F.col("x") * 2}, "following": "next"}
    whole = running(groups, "g", "pos", **options)
    cut = running(groups, "g", "pos", split=True, width=width, **options)
    assert cut.columns == [*groups.columns, "total", "twice", "n", "next"]
    columns = ("g", "pos", "x", "n", "total", "twice", F.coalesce("next", F.lit(-1)).alias("next"))
    assert rows(cut, *columns) == rows(whole, *columns)
    assert dict(cut.dtypes) == dict(whole.dtypes)


def test_a_long_group_is_spread_over_tasks(spark, groups):
    """Largest task against the mean, of a group that has a third of all rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = groups.union(groups.withColumn("g", F.col("g") + 1000).filter("g > 1000"))
        cut = running(many, "g", "pos", number="n", split=True, width=25)
        sizes = [r["count"] for r in cut.filter("n > 0").groupBy(F.spark_partition_id()).count().collect()]
        alone = running(many, "g", "pos", number="n").filter("n > 0").groupBy(F.spark_partition_id()).count()
        assert max(sizes) < 2 * sum(sizes) / 8
        assert max(r["count"] for r in alone.collect()) > max(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_is_long_reads_one_column(spark, groups):
    assert is_long(groups, "pos", 1000) and not is_long(groups, "pos", 5000)
    assert not is_long(groups.filter("g < 0"), "pos", 1)


def test_short_groups_take_one_window(groups):
    assert plan(running(groups, "g", "pos", number="n")).count("Exchange") <= 2


@pytest.mark.parametrize("width", [2, 7])
def test_metrics_and_popular_items_of_long_lists(spark, monkeypatch, width):
    from basketrank.models.popularity import PopularityModel
    from basketrank.operators.evaluate import per_customer, unique_keep_order

    dice = random.Random(4)
    items = [f"i{n:02d}" for n in range(40)]
    lists = [(c, dice.choice(items), p) for c in range(9) for p in range(1, 3 + c * 6)]
    bought = sorted({(c, dice.choice(items)) for c in range(12) for _ in range(9)})
    shown = spark.createDataFrame(lists, "customer_id int, item_id string, pos int")
    truth = spark.createDataFrame(bought, "customer_id int, item_id string")
    weights = spark.createDataFrame([(1, i, float(n)) for n, i in enumerate(items)], "c int, item_id string, weight double")
    customers = spark.createDataFrame([(c,) for c in range(12)], "customer_id int")

    def found():
        model = PopularityModel.fit(weights)
        terms = per_customer(shown, truth, 10).fillna(-1.0)
        return (
            rows(unique_keep_order(shown), "customer_id", "pos", "item_id"),
            rows(terms, *terms.columns),
            rows(model.recommend(customers, 6, truth), "customer_id", "pos", "item_id"),
        )

    want = found()
    monkeypatch.setattr(scan, "SEGMENT", width)
    assert found() == want
