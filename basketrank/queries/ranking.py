"""Popularity lists, scored lists and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketrank.functions.staging import new_path, parts_for, stage
from basketrank.models.popularity import PopularityModel, popularity_ranking
from basketrank.operators import evaluate as ev
from basketrank.operators import matrix
from basketrank.operators.cross_features import cross_features
from basketrank.operators.interactions import interactions
from basketrank.operators.split import customers_of
from basketrank.queries.common import Case, base, round_sql, sql, tidy
from basketrank.queries.features import _CROSSED
from basketrank.queries.tables import POPULAR_SQL
from basketrank.sources.sinks import write_metrics


def popular_lists(case: Case, k: int = 10) -> DataFrame:
    """Unseen popular items of the validation customers with a history."""
    pairs = stage(interactions(case.train), "interactions")
    return PopularityModel.fit(pairs).recommend(case.known_customers, k, pairs)


def _popular(by: str):
    return lambda spark, folder: popular_lists(Case(spark, folder, by))


def _ranking(spark, folder):
    return tidy(popularity_ranking(interactions(Case(spark, folder).train)))


def scored_candidates(case: Case) -> DataFrame:
    rows = cross_features(case.candidates(), case.train, case.val_customers)
    return rows.withColumn("score", F.col("ui_covisit_score") + F.col("ui_history_count"))


def _rank(spark, folder):
    return tidy(matrix.rank_top_k(scored_candidates(Case(spark, folder, once=True))))


def _purchase_positions(case: Case) -> DataFrame:
    """Purchases in time order as lists with repeated items."""
    window = Window.partitionBy("customer_id").orderBy("updated_date", "item_id")
    # In parts that follow the input: sorting and grouping hold no more per task when it grows.
    lines = case.train.select("customer_id", "item_id", "updated_date")
    return lines.repartition(parts_for(lines), "customer_id").select(
        "customer_id", "item_id", F.row_number().over(window).alias("pos")
    )


def _dedup(spark, folder):
    return ev.unique_keep_order(_purchase_positions(Case(spark, folder)))


def _plain_names(df: DataFrame) -> DataFrame:
    return tidy(df.toDF(*[c.replace("@", "_top") for c in df.columns]))


def _metrics(summary, k: int):
    def run(spark, folder):
        case = Case(spark, folder)
        return _plain_names(summary(ev.per_customer(popular_lists(case), case.val, k), k))

    return run


def _evaluate(k: int):
    def run(spark, folder):
        case = Case(spark, folder)
        return _plain_names(ev.evaluate(popular_lists(case), case.val, k))

    return run


def _evaluate_history(spark, folder):
    """Past purchases with repeats as lists; customers without a list count too."""
    case = Case(spark, folder)
    customers = customers_of(case.train).union(customers_of(case.val)).distinct()
    return _plain_names(ev.evaluate(_purchase_positions(case), case.val, 10, customers))


def _popular_reloaded(spark, folder):
    case = Case(spark, folder)
    pairs = stage(interactions(case.train), "interactions")
    path = new_path(spark, "popularity")
    PopularityModel.fit(pairs).save(path)
    return PopularityModel.load(spark, path).recommend(case.known_customers, 10, pairs)


def _metrics_sink(spark, folder):
    """Metrics written as one JSON object and read back."""
    case = Case(spark, folder)
    path = new_path(spark, "metrics")
    metrics = ev.evaluate(popular_lists(case), case.val)
    write_metrics(metrics, path)
    return _plain_names(spark.read.schema(metrics.schema).json(path))


def _auc(spark, folder):
    case = Case(spark, folder, once=True)
    return tidy(ev.auc(matrix.label_candidates(scored_candidates(case), case.val)))


QUERIES = {
    "popularity_reloaded": _popular_reloaded,
    "metrics_sink": _metrics_sink,
    "auc": _auc,
    "popularity_ranking": _ranking,
    "popularity_topk": _popular("group"),
    "popularity_topk_part": _popular("part"),
    "rank_topk": _rank,
    "predictions_dedup": _dedup,
    "metrics_topk": _metrics(lambda terms, k: ev.top_k_metrics(terms, k), 10),
    "metrics_topk_k3": _metrics(lambda terms, k: ev.top_k_metrics(terms, k), 3),
    "metrics_pir": _metrics(lambda terms, k: ev.list_metrics(terms), 10),
    "evaluate": _evaluate(10),
    "evaluate_k5": _evaluate(5),
    "evaluate_history": _evaluate_history,
}

_POPULAR = "SELECT customer_id, item_id, CAST(pos AS INTEGER) AS pos FROM popular"

_POSITIONS = """
positions AS (
    SELECT customer_id, item_id,
           row_number() OVER (PARTITION BY customer_id ORDER BY updated_date, item_id) AS pos
    FROM train)"""


def metric_ctes(lists: str, customers: str, k: int) -> str:
    """Terms per customer, and the one-row summary ``m``."""
    return f"""
truth AS (SELECT DISTINCT customer_id, item_id FROM val),
marked AS (
    SELECT l.customer_id, l.item_id, l.pos, CAST(t.item_id IS NOT NULL AS INTEGER) AS hit,
           CAST(row_number() OVER (PARTITION BY l.customer_id, l.item_id ORDER BY l.pos) = 1
                AS INTEGER) AS first
    FROM {lists} l LEFT JOIN truth t ON l.customer_id = t.customer_id AND l.item_id = t.item_id),
ranked AS (
    SELECT *, sum(first) OVER w AS rank, sum(first * hit) OVER w AS so_far FROM marked
    WINDOW w AS (PARTITION BY customer_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
sizes AS (SELECT customer_id, count(*) AS n_truth FROM truth GROUP BY customer_id),
sums AS (
    SELECT customer_id, sum(first) AS n_items, sum(first * hit) AS hits,
        sum(CASE WHEN pos <= {k} THEN first * hit ELSE 0 END) AS hits_in_k,
        sum(CASE WHEN rank <= {k} THEN first * hit ELSE 0 END) AS hits_in_k_unique,
        sum(CASE WHEN pos <= {k} THEN hit / log2(pos + 1) ELSE 0 END) AS gain,
        sum(first * hit * so_far / rank) AS precision_sum,
        min(CASE WHEN first * hit = 1 THEN rank END) AS first_hit
    FROM ranked GROUP BY customer_id),
terms AS (
    SELECT u.customer_id, n_truth, coalesce(hits, 0) AS hits, coalesce(n_items, 0) AS n_items,
        coalesce(hits_in_k, 0) AS hits_in_k, coalesce(hits_in_k_unique, 0) AS hits_in_k_unique,
        coalesce(gain, 0.0) AS gain, coalesce(precision_sum, 0.0) AS precision_sum, first_hit,
        CASE WHEN n_truth IS NOT NULL THEN least(n_truth, {k}) END AS best
    FROM {customers} u LEFT JOIN sums s ON u.customer_id = s.customer_id
    LEFT JOIN sizes z ON u.customer_id = z.customer_id),
m AS (
    SELECT avg(CAST(hits_in_k AS DOUBLE) / best) AS recall,
        avg(CASE WHEN n_truth IS NOT NULL THEN CAST(hits_in_k AS DOUBLE) / {k} END) AS precision,
        avg(gain / list_sum(list_transform(range(1, best + 1), lambda i: 1 / log2(i + 1)))) AS ndcg,
        avg(CASE WHEN n_truth IS NOT NULL AND hits_in_k > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
        count(*) AS n_users_predicted, count(n_truth) AS n_users_in_gt,
        CAST(sum(CASE WHEN n_truth IS NOT NULL THEN hits END) AS BIGINT) AS total_correct,
        avg(CAST(hits_in_k_unique AS DOUBLE) / best) AS list_precision,
        avg(precision_sum / n_truth) AS map,
        avg(CAST(hits AS DOUBLE) / (n_truth + n_items - hits)) AS iou,
        avg(CASE WHEN n_truth IS NOT NULL THEN coalesce(1.0 / first_hit, 0.0) END) AS rr
    FROM terms)"""


def top_k_metrics(k: int, precision: str = "precision") -> str:
    return ", ".join(
        [
            round_sql("recall", f"recall_top{k}"),
            round_sql(precision, f"precision_top{k}"),
            round_sql("ndcg", f"ndcg_top{k}"),
            round_sql("hit_rate", f"hit_rate_top{k}"),
            "n_users_predicted",
            "n_users_in_gt",
        ]
    )


LIST_METRICS = ", ".join(
    [
        "total_correct AS total_correct_recommendations",
        round_sql("list_precision", "precision_at_10"),
        round_sql("map", "map"),
        round_sql("iou", "iou"),
        round_sql("rr", "reciprocal_rank_first_hit"),
    ]
)


def _popular_metrics(select: str, k: int) -> str:
    predicted = "(SELECT DISTINCT customer_id FROM popular)"
    return sql(
        f"SELECT {select} FROM m", base(), POPULAR_SQL, metric_ctes("popular", predicted, k)
    )


_EVALUATED = _popular_metrics(f"{top_k_metrics(10, 'list_precision')}, {LIST_METRICS}", 10)

SQL = {
    "popularity_reloaded": sql(_POPULAR, base(), POPULAR_SQL),
    "metrics_sink": _EVALUATED,
    "auc": sql(
        f"""SELECT {round_sql("(ranks - pos * (pos + 1) / 2.0) / (pos * (n - pos))", "auc")} FROM (
            SELECT sum(CASE WHEN label = 1 THEN rank + (ties - 1) / 2.0 END) AS ranks,
                   sum(label) AS pos, count(*) AS n
            FROM (SELECT label, rank() OVER (ORDER BY score) AS rank,
                         count(*) OVER (PARTITION BY score) AS ties
                  FROM (SELECT c.ui_covisit_score + c.ui_history_count AS score,
                               CAST(v.item_id IS NOT NULL AS INTEGER) AS label
                        FROM crossed c LEFT JOIN (SELECT DISTINCT customer_id, item_id FROM val) v
                          ON c.customer_id = v.customer_id AND c.item_id = v.item_id)))""",
        *_CROSSED,
    ),
    "popularity_ranking": sql(
        "SELECT item_id, CAST(weight AS DOUBLE) AS weight, rank FROM ranking", base(), POPULAR_SQL
    ),
    "popularity_topk": sql(_POPULAR, base(), POPULAR_SQL),
    "popularity_topk_part": sql(_POPULAR, base("part"), POPULAR_SQL),
    "rank_topk": sql(
        """SELECT customer_id, item_id, score,
            CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_id)
                 AS INTEGER) AS pos
        FROM (SELECT *, ui_covisit_score + ui_history_count AS score FROM crossed)
        QUALIFY pos <= 10""",
        *_CROSSED,
    ),
    "predictions_dedup": sql(
        """SELECT customer_id, item_id,
            CAST(row_number() OVER (PARTITION BY customer_id ORDER BY min(pos)) AS INTEGER) AS pos
        FROM positions GROUP BY customer_id, item_id""",
        base(),
        _POSITIONS,
    ),
    "metrics_topk": _popular_metrics(top_k_metrics(10), 10),
    "metrics_topk_k3": _popular_metrics(top_k_metrics(3), 3),
    "metrics_pir": _popular_metrics(LIST_METRICS, 10),
    "evaluate": _EVALUATED,
    "evaluate_k5": _popular_metrics(f"{top_k_metrics(5)}, {LIST_METRICS}", 5),
    "evaluate_history": sql(
        f"SELECT {top_k_metrics(10, 'list_precision')}, {LIST_METRICS} FROM m",
        base(),
        _POSITIONS,
        metric_ctes(
            "positions",
            "(SELECT customer_id FROM positions UNION SELECT customer_id FROM val)",
            10,
        ),
    ),
}
