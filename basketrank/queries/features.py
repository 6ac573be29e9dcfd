"""User, item and pair features, labels and sampled training pairs."""

from __future__ import annotations

from basketrank.functions.expressions import latest
from basketrank.functions.staging import stage
from basketrank.operators import matrix
from basketrank.operators.cross_features import cross_features, user_item_stats
from basketrank.operators.item_features import CATEGORIES, item_features, label_encode
from basketrank.operators.user_features import category_breadth, user_features
from basketrank.queries.common import (
    Case,
    base,
    round_sql,
    rounded,
    sql,
    tidy,
    with_all_candidates,
)


def _user_features(spark, folder):
    return tidy(user_features(Case(spark, folder).train))


def _item_features(by: str):
    def run(spark, folder):
        case = Case(spark, folder, by)
        return tidy(item_features(case.train, case.items))

    return run


def _cross(spark, folder):
    case = Case(spark, folder, once=True)
    return tidy(cross_features(case.candidates(), case.train, case.val_customers))


def labelled_matrix(case: Case):
    ref = latest(case.train, "updated_date")
    return matrix.feature_matrix(
        case.candidates(),
        case.train,
        user_features(case.train, ref=ref),
        stage(item_features(case.train, case.items, ref=ref), "items"),
        case.val,
        customers=case.val_customers,
        ref=ref,
    )


def labelled_pairs(case: Case, distinct: bool = True):
    """Labels need the candidates only, not their features."""
    labelled = matrix.label_candidates(case.candidates(), case.val, distinct)
    return labelled.select("customer_id", "item_id", "label")


def _labels(distinct: bool):
    return lambda spark, folder: labelled_pairs(Case(spark, folder, once=True), distinct)


def _negatives(spark, folder):
    pairs = stage(labelled_pairs(Case(spark, folder, once=True)), "labelled")
    return matrix.sample_pairs(pairs, negatives_per_positive=3)


QUERIES = {
    "user_features": _user_features,
    "user_category_breadth": lambda spark, folder: category_breadth(
        Case(spark, folder).train, Case(spark, folder).items
    ),
    "item_features": _item_features("group"),
    "item_features_part": _item_features("part"),
    "label_encode_items": lambda spark, folder: label_encode(Case(spark, folder).items).select(
        "item_id", *[f"{c}_enc" for c in CATEGORIES]
    ),
    "label_encode_items_part": lambda spark, folder: label_encode(
        Case(spark, folder, "part").items
    ).select("item_id", *[f"{c}_enc" for c in CATEGORIES]),
    "user_item_stats": lambda spark, folder: tidy(user_item_stats(Case(spark, folder).train)),
    "cross_features": _cross,
    "feature_matrix": lambda spark, folder: tidy(labelled_matrix(Case(spark, folder, once=True))),
    "label_candidates": _labels(True),
    "label_candidates_fanout": _labels(False),
    "negative_sampling": _negatives,
}

_REF = "(SELECT max(updated_date) FROM train)"


def _recent(days: int, name: str) -> str:
    return (
        f"count(*) FILTER (WHERE updated_date >= {_REF} - INTERVAL {days} DAY) AS {name}"
    )


USER = f"""
user_base AS (
    SELECT customer_id, count(*) AS u_n_transactions,
        count(DISTINCT item_id) AS u_n_unique_items, count(DISTINCT bill_id) AS u_n_unique_bills,
        CAST(sum(quantity) AS DOUBLE) AS u_total_quantity,
        CAST(sum(price * quantity) AS DOUBLE) AS u_total_spend,
        CAST(sum(price) AS DOUBLE) / count(*) AS u_avg_price,
        CAST(sum(discount) AS DOUBLE) / count(*) AS u_avg_discount,
        count(DISTINCT CAST(updated_date AS DATE)) AS u_n_days_active,
        CAST(date_sub('day', max(updated_date), {_REF}) AS INTEGER) AS u_days_since_last,
        CAST(date_sub('day', min(updated_date), max(updated_date)) AS INTEGER) AS u_span_days,
        {", ".join(_recent(d, f"u_purchases_last_{d}d") for d in (30, 60, 90))},
        {", ".join(
            f"count(*) FILTER (WHERE month(updated_date) = {m}) AS u_month_{m}_count"
            for m in range(1, 11))}
    FROM train GROUP BY customer_id),
user_feats AS (
    SELECT *, CAST(u_n_transactions AS DOUBLE) / (u_span_days + 1) AS u_purchase_freq,
        u_total_spend / u_n_unique_bills AS u_avg_bill_size,
        CAST(u_span_days < 60 AS INTEGER) AS u_is_new_user
    FROM user_base)"""

ITEM = f"""
item_base AS (
    SELECT item_id, count(*) AS i_n_purchases, count(DISTINCT customer_id) AS i_n_unique_buyers,
        count(DISTINCT bill_id) AS i_n_bills, CAST(sum(quantity) AS DOUBLE) AS i_total_quantity,
        CAST(sum(price) AS DOUBLE) / count(*) AS i_avg_price,
        CAST(sum(discount) AS DOUBLE) / count(*) AS i_avg_discount,
        CAST(sum(quantity) AS DOUBLE) / count(*) AS i_avg_quantity,
        {", ".join(_recent(d, f"i_purchase_last_{d}d") for d in (30, 90))}
    FROM train GROUP BY item_id),
item_places AS (
    SELECT *, row_number() OVER (ORDER BY i_n_purchases) - 1 AS place, count(*) OVER () AS n
    FROM item_base),
months AS (
    SELECT greatest(1.0, date_sub('day', min(updated_date), max(updated_date)) / 30.0) AS span
    FROM train),
encoded AS (
    SELECT item_id, sale_status, price,
        {", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY {c} NULLS FIRST) - 1 "
            f"AS INTEGER) END AS {c}_enc" for c in CATEGORIES)}
    FROM items),
item_feats AS (
    SELECT b.*,
        CAST(row_number() OVER (ORDER BY b.i_n_purchases DESC, b.item_id) AS DOUBLE) AS i_popularity_rank,
        CAST(i_n_unique_buyers AS DOUBLE) / (i_n_purchases + 1) AS i_buyer_diversity,
        CAST(i_n_purchases >= (SELECT max(i_n_purchases) FROM item_places
                               WHERE place = CAST(floor((9 * (n - 1) + 5) / 10.0) AS BIGINT))
             AS INTEGER) AS i_is_popular,
        i_purchase_last_30d / (i_n_purchases / (SELECT span FROM months) + 1) AS i_trend_score,
        e.sale_status AS i_sale_status,
        {", ".join(f"e.{c}_enc AS i_{c}_enc" for c in CATEGORIES)},
        CAST(e.price AS DOUBLE) AS i_list_price
    FROM item_base b LEFT JOIN encoded e ON b.item_id = e.item_id)"""

CROSS = f"""
pair_stats AS (
    SELECT customer_id, item_id, 1 AS ui_in_history, count(*) AS ui_history_count,
        CAST(date_sub('day', max(updated_date), {_REF}) AS DOUBLE) AS ui_history_last_days
    FROM train GROUP BY customer_id, item_id),
crossed AS (
    SELECT c.customer_id, c.item_id, from_history, from_covisit, from_w2v,
        coalesce(ui_in_history, 0) AS ui_in_history,
        coalesce(ui_history_count, 0) AS ui_history_count,
        coalesce(ui_history_last_days, 9999.0) AS ui_history_last_days,
        coalesce(covisit_score, 0.0) AS ui_covisit_score,
        coalesce(w2v_score, 0.0) AS ui_w2v_score
    FROM candidates c LEFT JOIN pair_stats p
      ON c.customer_id = p.customer_id AND c.item_id = p.item_id),
bought AS (SELECT DISTINCT customer_id, item_id FROM val),
labelled AS (
    SELECT c.*, CAST(b.item_id IS NOT NULL AS INTEGER) AS label
    FROM crossed c LEFT JOIN bought b ON c.customer_id = b.customer_id AND c.item_id = b.item_id)"""

_USER_DOUBLES = (
    "u_total_quantity", "u_total_spend", "u_avg_price", "u_avg_discount", "u_purchase_freq",
    "u_avg_bill_size",
)
_ITEM_DOUBLES = (
    "i_total_quantity", "i_avg_price", "i_avg_discount", "i_avg_quantity", "i_popularity_rank",
    "i_buyer_diversity", "i_trend_score", "i_list_price",
)
_CROSS_DOUBLES = ("ui_history_last_days", "ui_covisit_score")


def _item_sql(by: str) -> str:
    return sql(f"SELECT * REPLACE ({rounded(*_ITEM_DOUBLES)}) FROM item_feats", base(by), ITEM)


def _encode_sql(by: str) -> str:
    names = ", ".join(f"{c}_enc" for c in CATEGORIES)
    return sql(f"SELECT item_id, {names} FROM encoded", base(by), ITEM)


_CROSSED = (*with_all_candidates(), CROSS)

_FILLED = ", ".join(
    f"coalesce({c}, 0) AS {c}"
    for c in ("i_sale_status", *[f"i_{c}_enc" for c in CATEGORIES])
)

SQL = {
    "user_features": sql(
        f"SELECT * REPLACE ({rounded(*_USER_DOUBLES)}) FROM user_feats", base(), USER
    ),
    "user_category_breadth": sql(
        "SELECT customer_id, count(DISTINCT category_l1) AS u_n_unique_categories_l1 "
        "FROM train JOIN items ON train.item_id = items.item_id GROUP BY customer_id"
    ),
    "item_features": _item_sql("group"),
    "item_features_part": _item_sql("part"),
    "label_encode_items": _encode_sql("group"),
    "label_encode_items_part": _encode_sql("part"),
    "user_item_stats": sql("SELECT * FROM pair_stats", base(), *_CROSSED[1:]),
    "cross_features": sql(
        f"SELECT * REPLACE ({rounded(*_CROSS_DOUBLES)}) FROM crossed", *_CROSSED
    ),
    "feature_matrix": sql(
        f"""SELECT * REPLACE ({rounded(*_CROSS_DOUBLES, *_USER_DOUBLES, *_ITEM_DOUBLES)}),
            {round_sql("i_avg_price / (u_avg_price + 0.000001)", "ui_price_ratio")}
        FROM (SELECT l.*, u.* EXCLUDE (customer_id), i.* EXCLUDE (item_id) REPLACE ({_FILLED})
              FROM labelled l LEFT JOIN user_feats u ON l.customer_id = u.customer_id
              LEFT JOIN item_feats i ON l.item_id = i.item_id)""",
        *_CROSSED,
        USER,
        ITEM,
    ),
    "label_candidates": sql("SELECT customer_id, item_id, label FROM labelled", *_CROSSED),
    "label_candidates_fanout": sql(
        """SELECT c.customer_id, c.item_id, CAST(v.item_id IS NOT NULL AS INTEGER) AS label
        FROM candidates c LEFT JOIN val v
          ON c.customer_id = v.customer_id AND c.item_id = v.item_id""",
        *_CROSSED,
    ),
    "negative_sampling": sql(
        """SELECT customer_id, item_id, label FROM labelled WHERE label = 1
        UNION ALL
        SELECT customer_id, item_id, label FROM (
            SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|',
                CAST(customer_id AS VARCHAR), item_id, '42')), customer_id, item_id) AS place
            FROM labelled WHERE label = 0)
        WHERE place <= 3 * (SELECT count(*) FROM labelled WHERE label = 1)""",
        *_CROSSED,
    ),
}
