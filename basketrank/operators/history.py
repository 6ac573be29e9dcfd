"""Candidate source 1: what a customer bought, most recent first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketrank.config import CandidateLimits
from basketrank.functions.ordering import top_n


def history_candidates(
    transactions: DataFrame, max_items: int | None = CandidateLimits.history
) -> DataFrame:
    """(customer_id, item_id, last_date, pos), at most ``max_items`` per customer."""
    recency = transactions.groupBy("customer_id", "item_id").agg(
        F.max("updated_date").alias("last_date")
    )
    order = [F.col("last_date").desc(), F.col("item_id")]
    return top_n(recency, "customer_id", order, max_items)
