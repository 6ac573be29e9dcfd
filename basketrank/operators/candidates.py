"""Stage 1: merge the three candidate sources per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketrank.config import CandidateLimits
from basketrank.functions.joins import fits_broadcast
from basketrank.functions.ordering import renumber, top_n
from basketrank.functions.staging import parts_for, stage
from basketrank.operators.covisit import NeighbourIndex, covisit_candidates
from basketrank.operators.embedding import vector_candidates
from basketrank.operators.history import history_candidates
from basketrank.operators.split import of_customers, only_items

# Sources in the order in which they fill a customer's list.
SOURCES = ("history", "covisit", "w2v")


def merge_candidates(
    history: DataFrame,
    covisit: DataFrame,
    vectors: DataFrame | None = None,
    total: int | None = CandidateLimits.total,
    parts: int | None = None,
) -> DataFrame:
    """One row per (customer_id, item_id) with source flags, scores and position.

    An item keeps the place of the first source that names it. The sources move to
    their customers in one shuffle, and the result stays partitioned by customer, in
    ``parts`` partitions (default: those of other shuffles).
    """
    columns = ("customer_id", "item_id", "pos")
    tables = [history.select(*columns, F.lit(0.0).alias("score"))]
    for table in (covisit, vectors):
        if table is not None:
            tables.append(table.select(*columns, F.col("score").cast("double").alias("score")))
    union = None
    for rank, table in enumerate(tables):
        part = table.withColumn("source", F.lit(rank))
        union = part if union is None else union.unionByName(part)

    def flag(rank: int):
        return F.max((F.col("source") == rank).cast("int"))

    def score(rank: int):
        return F.max(F.when(F.col("source") == rank, F.col("score")))

    # Dealt once, in parts of a fixed number, which adaptive execution does not merge.
    parts = parts or int(union.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One number for source and place, null first, which a hash aggregate can hold where a struct is sorted for.
    place = F.col("source").cast("long") * F.lit(1 << 40) + F.coalesce(F.col("pos").cast("long"), F.lit(-1))
    merged = union.repartition(parts, "customer_id").groupBy("customer_id", "item_id").agg(
        F.min(place).alias("_place"),
        *[flag(rank).alias(f"from_{name}") for rank, name in enumerate(SOURCES)],
        score(1).alias("covisit_score"),
        score(2).alias("w2v_score"),
    )
    return top_n(merged, "customer_id", [F.col("_place")], total).drop("_place")


def generate_candidates(
    transactions: DataFrame,
    customers: DataFrame,
    neighbours: DataFrame | NeighbourIndex,
    vectors: DataFrame | None = None,
    active: DataFrame | None = None,
    limits: CandidateLimits = CandidateLimits(),
    *,
    dims: int = 64,
) -> DataFrame:
    """Candidates of the given customers.

    Every source is cut to its limit before items that are not on sale are
    dropped, and "already bought" means the cut and filtered history.
    """

    fits = None if active is None else fits_broadcast(active, row_bytes=64)

    def on_sale(df: DataFrame) -> DataFrame:
        return df if active is None else only_items(df, active, fits)

    # Read several times by each of the sources, so written once; the customers are sent out for it once.
    parts = parts_for(transactions)
    history = history_candidates(of_customers(transactions, customers), limits.history)
    if fits is False:
        history = stage(history, "history")
    history = stage(renumber(on_sale(history), "customer_id"), "own-history")
    covisit = on_sale(covisit_candidates(history, neighbours, limits.covisit, parts=parts))
    near = None
    if vectors is not None:
        near = on_sale(
            vector_candidates(
                history, vectors, limits.vectors, limits.recent_items, limits.decay, dims=dims
            )
        )
    return merge_candidates(history, covisit, near, limits.total, parts)
