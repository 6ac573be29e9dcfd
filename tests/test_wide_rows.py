"""Candidates move once, and their wide rows stay in code that the JVM compiles."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketrank import config
from basketrank.functions import staging
from basketrank.functions.joins import add_by_pair
from basketrank.functions.vectors import top_k_by_dot
from basketrank.models.boosting import BoostedTrees
from basketrank.operators.candidates import merge_candidates
from basketrank.operators.matrix import feature_matrix
from conftest import plan, rows

# HotSpot never compiles a method of more bytes of code than this.
COMPILED = 8000


def test_feature_rows_are_compiled(spark, small):
    from basketrank.queries import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = QUERIES["feature_matrix"](spark, small)._jdf.queryExecution()
        text = spark._jvm.PythonSQLUtils.explainString(execution, "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < COMPILED


def test_features_are_filled_and_the_ratio_is_not_made_of_filled_prices(spark):
    found = spark.createDataFrame(
        [(1, "a", 1, None), (1, "b", 0, float("nan")), (2, "a", 0, 0.5)],
        "customer_id int, item_id string, from_history int, covisit_score double",
    ).withColumns({"w2v_score": F.lit(0.0), "pos": F.lit(1)})
    lines = spark.createDataFrame([(1, "a", "2024-01-01")], "customer_id int, item_id string, day string")
    lines = lines.select("customer_id", "item_id", F.col("day").cast("timestamp_ntz").alias("updated_date"))
    users = spark.createDataFrame([(1, None, 7)], "customer_id int, u_avg_price double, u_n int")
    items = spark.createDataFrame([("a", 6.0, float("nan")), ("b", None, 2.0)], "item_id string, i_avg_price double, i_x double")
    made = feature_matrix(found, lines, users, items)
    columns = ("customer_id", "item_id", "u_avg_price", "u_n", "i_avg_price", "i_x", "ui_covisit_score", "ui_price_ratio")
    assert rows(made, *columns) == [
        (1, "a", 0.0, 7, 6.0, 0.0, 0.0, 0.0), (1, "b", 0.0, 7, 0.0, 2.0, 0.0, 0.0), (2, "a", 0.0, 0, 6.0, 0.0, 0.5, 0.0),
    ]
    assert not any(c.startswith("_") for c in made.columns)
    priced = users.fillna(3.0, ["u_avg_price"])
    got = rows(feature_matrix(found, lines, priced, items).filter("customer_id = 1 AND item_id = 'a'"), "ui_price_ratio")
    assert got == [(pytest.approx(6.0 / (3.0 + config.PRICE_RATIO_OFFSET)),)]


def test_merge_groups_without_a_sort(spark):
    table = "customer_id int, item_id string, pos int, score double"
    history = spark.createDataFrame([(1, "a", 2, 0.0), (1, "b", None, 0.0)], table)
    together = spark.createDataFrame([(1, "c", 1, 9.0), (1, "a", 1, 3.0)], table)
    merged = merge_candidates(history, together, None, total=5)
    assert "SortAggregate" not in plan(merged)
    assert rows(merged, "pos", "item_id") == [(1, "b"), (2, "a"), (3, "c")]


def test_pairs_meet_candidates_where_they_lie(spark, monkeypatch, tmp_path):
    spark.range(500).selectExpr("cast(id % 50 as int) customer_id", "cast(id as string) item_id").write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    monkeypatch.setattr(staging, "BYTES_PER_PART", 100)
    parts = staging.parts_for(lines)
    assert parts > 16
    left = lines.repartition(parts, "customer_id").withColumn("x", F.lit(1))
    both = add_by_pair(left, lines.distinct().withColumn("y", F.lit(2)), lines)
    # The candidates, the distinct pairs, and these once more to their customers.
    assert plan(both).count("Exchange") == 3
    assert both.filter("x = 1 AND y = 2").count() == 500


def test_lists_of_a_small_catalogue_are_final(spark):
    rng = np.random.default_rng(8)
    asks = spark.createDataFrame([(c, rng.integers(-1, 2, 3).astype(float).tolist()) for c in range(40)], "customer_id int, vec array<double>")
    items = spark.createDataFrame([(f"i{n}", rng.integers(-1, 2, 3).astype(float).tolist()) for n in range(60)], "item_id string, vec array<double>")
    seen = spark.createDataFrame([(c, f"i{n}") for c in range(40) for n in range(c)], "customer_id int, item_id string")
    final = top_k_by_dot(asks, items, 9, seen, dims=3, one_each=True)
    assert "Window" not in plan(final)
    columns = ("customer_id", "pos", "item_id", "score")
    assert rows(final, *columns) == rows(top_k_by_dot(asks, items, 9, seen, dims=3), *columns)


def test_scores_of_columns_follow_the_nodes(spark):
    trees = pd.DataFrame(
        [(0, 0, 0, 0.5, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 0.25), (0, 2, 1, 2.0, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, -1.0),
         (0, 4, -1, 0.0, -1, -1, 3.0), (1, 0, -1, 0.0, -1, -1, 0.125)],
        columns=["tree", "node", "feature_at", "threshold", "left", "right", "value"],
    )
    model = BoostedTrees(["p", "q"], 0.5, trees)
    table = [(0.5, 9.0), (0.6, 2.0), (0.6, 2.1), (None, 9.0), (float("nan"), 0.0)]
    want = [0.25, -1.0, 3.0, 0.25, -1.0]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(table)], "i int, p double, q double")
    scored = df.withColumn("score", model.probability())
    assert "ArrowEvalPython" in plan(scored)
    got = [r["score"] for r in scored.orderBy("i").collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-(0.625 + w))) for w in want])


def test_vectors_of_different_lengths_are_refused():
    import pyarrow as pa

    from basketrank.functions.vectors import _lists_matrix

    assert _lists_matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1.0, 2.0], [3.0, 4.0]]
    for bad in ([[1.0, 2.0], None], [[1.0], [2.0, 3.0, 4.0]]):
        with pytest.raises(ValueError):
            _lists_matrix(pa.array(bad))
