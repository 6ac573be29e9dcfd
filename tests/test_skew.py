"""A third of all lines on one customer, one item and one bill, and nothing broadcast."""

from __future__ import annotations

import shutil

import duckdb
import pytest
from compare import database, differences

from basketrank.functions import joins
from basketrank.operators import covisit, item_features
from basketrank.queries import QUERIES, SQL

NAMES = [
    "history_candidates",
    "history_for_users",
    "interactions",
    "purchase_sequences",
    "user_features",
    "user_category_breadth",
    "item_features",
    "label_encode_items_part",
    "covisit_matrix",
    "covisit_candidates",
    "covisit_candidates_part",
    "decayed_user_vector",
    "knn_cosine",
    "generate_candidates_part",
    "feature_matrix",
    "cross_features",
    "predictions_dedup",
    "ground_truth_lists",
    "top_dot_embeddings",
    "covisit_matrix_uncapped",
    "label_candidates",
    "negative_sampling",
    "popularity_topk",
    "popularity_topk_part",
    "evaluate",
    "evaluate_history",
]


@pytest.fixture(scope="module")
def skewed(small, tmp_path_factory):
    """The test tables with orders, lines and parts bent to one customer, bill and item."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    for table in ("part", "events", "embeddings"):
        shutil.copy(f"{small}/{table}.parquet", folder)
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)
            FROM '{small}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)"""
    )
    con.execute(
        f"""COPY (SELECT * REPLACE (
                CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey,
                CASE WHEN l_suppkey % 3 = 0 THEN 30 ELSE l_orderkey END AS l_orderkey)
            FROM '{small}/lineitem.parquet') TO '{folder}/lineitem.parquet' (FORMAT parquet)"""
    )
    return folder


@pytest.fixture(scope="module")
def nothing_fits(spark):
    patch = pytest.MonkeyPatch()
    for module in (joins, covisit, item_features):
        patch.setattr(module, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    patch.undo()


def test_the_tables_are_skewed(skewed):
    con = database(skewed)
    rows = con.execute(
        "SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"
    ).fetchall()
    assert rows[0][0] > 0.3


@pytest.mark.parametrize("name", NAMES)
def test_skewed_twin(spark, skewed, nothing_fits, name):
    assert differences(QUERIES[name](spark, skewed), database(skewed), SQL[name]) == []
