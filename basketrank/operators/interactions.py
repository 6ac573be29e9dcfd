"""Weighted customer-item interactions and their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketrank import config
from basketrank.functions.expressions import event_weight
from basketrank.functions.ordering import dense_index

# Weights are added as decimals, so sums do not depend on their order.
_WEIGHT = "decimal(18,4)"


def interactions(
    transactions: DataFrame,
    events: DataFrame | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(customer_id, item_id, weight): purchased quantity plus weighted events."""
    pairs = transactions.select(
        "customer_id", "item_id", F.col("quantity").cast(_WEIGHT).alias("weight")
    )
    if events is not None:
        weight = event_weight(weights or config.EVENT_WEIGHTS).cast(_WEIGHT)
        signals = events.select("customer_id", "item_id", weight.alias("weight"))
        pairs = pairs.unionByName(signals.filter("weight > 0"), allowMissingColumns=True)
    return pairs.groupBy("customer_id", "item_id").agg(F.sum("weight").alias("weight"))


def density(pairs: DataFrame) -> DataFrame:
    """Customers, items, stored pairs and the share of all possible pairs in percent."""
    return pairs.agg(
        F.count_distinct("customer_id").alias("n_customers"),
        F.count_distinct("item_id").alias("n_items"),
        F.count("*").alias("nnz"),
    ).withColumn(
        "density_pct",
        F.try_divide(
            F.lit(100.0) * F.col("nnz"), F.col("n_customers").cast("double") * F.col("n_items")
        ),
    )


def key_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Sorted distinct keys numbered from 0."""
    return dense_index(df.select(key).distinct(), [F.col(key)], name)


def purchased_items(df: DataFrame) -> DataFrame:
    """Distinct (customer_id, item_id)."""
    return df.select("customer_id", "item_id").distinct()
