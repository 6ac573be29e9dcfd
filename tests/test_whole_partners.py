"""Co-purchases of whole bills, every partner of an item, and a history that is computed once."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import plan, rows

from basketrank.queries import QUERIES
from basketrank.queries.common import Case

N = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A bill of 60 parts, more than 20 on a bill and more than 50 partners; customer 1 bought one of them alone."""
    place = str(tmp_path_factory.mktemp("star"))

    def write(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{place}/{name}.parquet")

    write("part", [(p, f"Brand#{p}1", "T", 9.5, 1) for p in range(1, N + 1)],
          "p_partkey long, p_brand string, p_type string, p_retailprice double, p_size int")
    orders = [(1, 1, datetime(1995, 3, 1)), (2, 2, datetime(1995, 3, 2)), (3, 1, datetime(1995, 11, 1))]
    write("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    lines = [(1, 7), (3, 7)] + [(2, p) for p in range(1, N + 1)]
    write("lineitem", [(o, p, 1.0, 0.0) for o, p in lines],
          "l_orderkey long, l_partkey long, l_quantity double, l_discount double")
    return place


def test_roundtrip_keeps_every_pair(spark, folder):
    found = QUERIES["covisit_roundtrip"](spark, folder)
    assert found.count() == N * (N - 1)
    assert {r.score for r in found.collect()} == {1}
    assert found.filter(f"rn = {N - 1}").count() == N


def test_every_partner_is_a_candidate(spark, folder):
    found = rows(QUERIES["covisit_candidates_part"](spark, folder), "customer_id", "item_id", "score")
    assert found == sorted((1, str(p), 1) for p in range(1, N + 1) if p != 7)


def test_history_of_a_case_is_read_back(spark, folder):
    found = Case(spark, folder, "part").history()
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
    assert rows(found, "customer_id", "item_id", "pos") == [(1, "7", 1)]
