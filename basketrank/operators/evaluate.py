"""Ranking metrics of predicted lists against purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketrank import config
from basketrank.functions.ordering import dense_index
from basketrank.functions.scan import is_long, running

# Decimal places of the list metrics.
LIST_METRIC_DIGITS = 6


def unique_keep_order(predictions: DataFrame) -> DataFrame:
    """Drop repeated items of a list, keep the first, close the gaps."""
    firsts = predictions.groupBy("customer_id", "item_id").agg(F.min("pos").alias("_place"))
    placed = running(firsts, "customer_id", "_place", number="pos", split=is_long(predictions, "pos"))
    return placed.drop("_place")


def truth_pairs(purchases: DataFrame) -> DataFrame:
    """Distinct (customer_id, item_id) that were bought."""
    return purchases.select("customer_id", "item_id").distinct()


def truth_lists(purchases: DataFrame) -> DataFrame:
    """Sorted distinct items per customer, for export."""
    return purchases.groupBy("customer_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")
    )


def _ideal_gain(n: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0))
    )


def per_customer(
    predictions: DataFrame,
    purchases: DataFrame,
    k: int = config.TOP_K,
    customers: DataFrame | None = None,
) -> DataFrame:
    """Metric terms of each predicted customer.

    ``customers`` names customers that count as predicted even when their list
    is empty; without it those with at least one row count. ``n_truth`` is null
    for customers who bought nothing.
    """
    truth = truth_pairs(purchases)
    rows = predictions.select("customer_id", "item_id", "pos").join(
        truth.withColumn("hit", F.lit(1)), ["customer_id", "item_id"], "left"
    )
    repeat = Window.partitionBy("customer_id", "item_id").orderBy("pos")
    marked = rows.withColumns(
        {
            "hit": F.coalesce("hit", F.lit(0)),
            "first": (F.row_number().over(repeat) == 1).cast("int"),
        }
    ).withColumn("new_hit", F.col("hit") * F.col("first"))
    rows = running(
        marked,
        "customer_id",
        "pos",
        sums={"rank": "first", "hits_so_far": "new_hit"},
        split=is_long(predictions, "pos"),
    )

    def count_new_hits(where: Column) -> Column:
        return F.sum(F.when(where, F.col("new_hit")).otherwise(0))

    lists = rows.groupBy("customer_id").agg(
        F.sum("first").alias("n_items"),
        F.sum("new_hit").alias("hits"),
        count_new_hits(F.col("pos") <= k).alias("hits_in_k"),
        count_new_hits(F.col("rank") <= k).alias("hits_in_k_unique"),
        F.sum(
            F.when(F.col("pos") <= k, F.col("hit") / F.log2(F.col("pos") + F.lit(1.0))).otherwise(0.0)
        ).alias("gain"),
        F.sum(F.col("new_hit") * F.col("hits_so_far") / F.col("rank")).alias("precision_sum"),
        F.min(F.when(F.col("new_hit") == 1, F.col("rank"))).alias("first_hit"),
    )
    if customers is not None:
        lists = customers.select("customer_id").distinct().join(lists, "customer_id", "left")
        counted = [c for c in lists.columns if c not in ("customer_id", "first_hit")]
        lists = lists.fillna(0, counted)
    sizes = truth.groupBy("customer_id").agg(F.count("*").cast("int").alias("n_truth"))
    joined = lists.join(sizes, "customer_id", "left")
    known = F.col("n_truth").isNotNull()
    best = F.when(known, F.least(F.col("n_truth"), F.lit(k)))  # least() alone skips nulls
    return joined.select(
        "customer_id",
        "n_truth",
        "hits",
        "hits_in_k",
        (F.col("hits_in_k") / best).alias("recall"),
        F.when(known, F.col("hits_in_k") / F.lit(k)).alias("precision"),
        (F.col("gain") / _ideal_gain(best)).alias("ndcg"),
        (F.col("hits_in_k_unique") / best).alias("list_precision"),
        (F.col("precision_sum") / F.col("n_truth")).alias("average_precision"),
        (F.col("hits") / (F.col("n_truth") + F.col("n_items") - F.col("hits"))).alias("iou"),
        F.when(known, F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row, ``auc``: the chance that a positive scores above a negative, ties half.

    Exact by the rank sum. Rows are numbered by one distributed ordering; equal
    scores share their middle number. Null without both kinds of rows.
    """
    placed = dense_index(rows.select(F.col(score).alias("s"), F.col(label).alias("y")), [F.col("s")], "at", 1)
    by_score = placed.groupBy("s").agg(
        ((F.min("at") + F.max("at")) / 2).alias("rank"), F.sum("y").alias("pos"), F.count("*").alias("n")
    )
    totals = by_score.agg(
        F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n")
    )
    least = F.col("pos") * (F.col("pos") + 1) / 2
    pairs = F.col("pos") * (F.col("n") - F.col("pos"))
    return totals.select(F.when(pairs > 0, (F.col("ranks") - least) / pairs).alias("auc"))


def list_contract(
    lists: DataFrame, seen: DataFrame | None = None, score: str | None = "score"
) -> DataFrame:
    """(customer_id, n_rows, n_seen, n_breaks): whether ranked lists keep their promises.

    Breaks are positions that do not follow on, and scores that rise.
    """
    if seen is None:
        marked = lists.withColumn("_seen", F.lit(0))
    else:
        known = seen.select("customer_id", "item_id").distinct().withColumn("_seen", F.lit(1))
        marked = lists.join(known, ["customer_id", "item_id"], "left")
    order = Window.partitionBy("customer_id").orderBy("pos")
    broken = F.col("pos") != F.row_number().over(order)
    if score:
        broken |= F.coalesce(F.lag(score).over(order) < F.col(score), F.lit(False))
    return (
        marked.withColumn("_break", broken.cast("int"))
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("n_rows"),
            F.sum(F.coalesce("_seen", F.lit(0))).alias("n_seen"),
            F.sum("_break").alias("n_breaks"),
        )
    )


def _mean(name: str) -> Column:
    return F.coalesce(F.avg(name), F.lit(0.0))


def _top_k_terms(k: int) -> list[Column]:
    hit = (F.col("hits_in_k") > 0).cast("int")
    return [
        _mean("recall").alias(f"recall@{k}"),
        _mean("precision").alias(f"precision@{k}"),
        _mean("ndcg").alias(f"ndcg@{k}"),
        F.coalesce(F.avg(F.when(F.col("n_truth").isNotNull(), hit).otherwise(0)), F.lit(0.0)).alias(
            f"hit_rate@{k}"
        ),
        F.count("*").alias("n_users_predicted"),
        F.count("n_truth").alias("n_users_in_gt"),
    ]


def _list_terms() -> list[Column]:
    def mean(name: str) -> Column:
        return F.round(_mean(name), LIST_METRIC_DIGITS)

    known = F.col("n_truth").isNotNull()
    return [
        F.coalesce(F.sum(F.when(known, F.col("hits"))), F.lit(0)).alias(
            "total_correct_recommendations"
        ),
        mean("list_precision").alias("precision_at_10"),
        mean("average_precision").alias("map"),
        mean("iou").alias("iou"),
        mean("reciprocal_rank").alias("reciprocal_rank_first_hit"),
    ]


def top_k_metrics(terms: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """Recall, precision, ndcg and hit rate of the first ``k``; one row."""
    return terms.agg(*_top_k_terms(k))


def list_metrics(terms: DataFrame) -> DataFrame:
    """Hits, precision, average precision, overlap and first hit of whole lists; one row.

    Only customers with purchases count. The precision column keeps its name for
    any cut-off.
    """
    return terms.agg(*_list_terms())


def evaluate(
    predictions: DataFrame,
    purchases: DataFrame,
    k: int = config.TOP_K,
    customers: DataFrame | None = None,
) -> DataFrame:
    """All metrics in one row.

    At k = 10 ``precision@10`` is the list precision, whose denominator is the
    smaller of k and the number of bought items.
    """
    terms = per_customer(predictions, purchases, k, customers)
    row = terms.agg(*_top_k_terms(k), *_list_terms())
    if k == 10:
        row = row.withColumn("precision@10", F.col("precision_at_10"))
    return row
