"""Scans, splits, profiles and user selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketrank.functions.expressions import n_distinct
from basketrank.functions.ordering import hash_take
from basketrank.functions.staging import new_path, stage
from basketrank.models.popularity import PopularityModel
from basketrank.operators import interactions as inter
from basketrank.operators import profile, split
from basketrank.operators.evaluate import truth_lists
from basketrank.queries.common import Case, base, round_sql, rounded, side_by_side, sql, tidy
from basketrank.sources import sinks

_TX = "customer_id, item_id, bill_id, quantity, price, discount, updated_date"
_TX_SQL = f"customer_id, item_id, bill_id, quantity, {rounded('price', 'discount')}, updated_date"
_TS = "updated_date"
_YEAR = split.SplitRule(year=2000)
_EVENT_YEAR = split.SplitRule(year=2024)


def _scan(table: str):
    return lambda spark, folder: tidy(getattr(Case(spark, folder), table))


def _split_transactions(rule: split.SplitRule):
    return lambda spark, folder: tidy(split.with_part(Case(spark, folder).tx, _TS, rule))


def _split_stats(rule: split.SplitRule):
    return lambda spark, folder: tidy(split.split_stats(Case(spark, folder).tx, _TS, rule))


def _split_events(spark, folder):
    return split.with_part(Case(spark, folder).events, "event_date", _EVENT_YEAR)


def _history_window(spark, folder):
    """Rows and customers of history and target, for every prediction target."""
    return (
        split.by_target(Case(spark, folder).tx)
        .groupBy("target", "role")
        .agg(
            F.count("*").alias("n_rows"),
            n_distinct("customer_id").alias("n_customers"),
            F.sum("quantity").alias("quantity"),
        )
    )


def _history_window_sql() -> str:
    months = {"val": (10, 11, 11), "test": (11, 12, 12), "jan2026": (12, 12, 12)}
    parts = []
    for target, (last, first_t, last_t) in months.items():
        for role, lo, hi in (("history", 1, last), ("target", first_t, last_t)):
            parts.append(
                f"SELECT '{target}' AS target, '{role}' AS role, count(*) AS n_rows, "
                "count(DISTINCT customer_id) AS n_customers, "
                "CAST(sum(quantity) AS BIGINT) AS quantity "
                f"FROM tx WHERE month(updated_date) BETWEEN {lo} AND {hi}"
            )
    return sql(" UNION ALL ".join(parts))


def _popular_lists(case: Case, customers):
    pairs = stage(inter.interactions(case.train), "interactions")
    return PopularityModel.fit(pairs).recommend(customers, 10, pairs)


POPULAR_SQL = """
weights AS (
    SELECT customer_id, item_id, sum(quantity) AS weight FROM train GROUP BY ALL),
ranking AS (
    SELECT item_id, sum(weight) AS weight,
           row_number() OVER (ORDER BY sum(weight) DESC, item_id) AS rank
    FROM weights GROUP BY item_id),
popular AS (
    SELECT u.customer_id, r.item_id,
           row_number() OVER (PARTITION BY u.customer_id ORDER BY r.rank) AS pos
    FROM known_customers u CROSS JOIN ranking r
    WHERE NOT EXISTS (SELECT 1 FROM weights w
                      WHERE w.customer_id = u.customer_id AND w.item_id = r.item_id)
    QUALIFY pos <= 10)"""


def _predictions_sink(spark, folder):
    """Written as JSON lines and read back; customers without predictions get no items."""
    case = Case(spark, folder)
    path = new_path(spark, "predictions")
    lists = sinks.prediction_lists(_popular_lists(case, case.known_customers), case.val_customers)
    sinks.write_lists(lists, path)
    return sinks.read_lists(spark, path).select(
        "customer_id", F.concat_ws(",", "items").alias("items")
    )


def _ground_truth(spark, folder):
    path = new_path(spark, "truth")
    sinks.write_lists(truth_lists(Case(spark, folder).part(split.TEST)), path)
    return sinks.read_lists(spark, path).select(
        "customer_id", F.concat_ws(",", "items").alias("items")
    )


def _first_customers(case: Case):
    return hash_take(case.val_customers, ["customer_id"], 100)


def _resume(spark, folder):
    """Customers left after a run that wrote the predictions of 100 of them."""
    case = Case(spark, folder)
    path = new_path(spark, "partial")
    first = _first_customers(case)
    sinks.write_lists(sinks.prediction_lists(_popular_lists(case, first), first), path)
    return sinks.remaining_customers(case.val_customers, sinks.finished_customers(spark, path))


def _rerun(spark, folder):
    """A second run over a finished one: its lists are those of the second model."""
    case = Case(spark, folder)
    path = new_path(spark, "rerun")
    first = case.val_customers.select(
        "customer_id", F.lit("none").alias("item_id"), F.lit(1).alias("pos")
    )
    sinks.write_resumable(
        case.val_customers, lambda part, bucket: first.join(part, "customer_id"), path, 2, tag="a"
    )
    lists = stage(_popular_lists(case, case.known_customers), "lists")
    sinks.write_resumable(
        case.val_customers, lambda part, bucket: lists.join(part, "customer_id"), path, 2, tag="b"
    )
    return sinks.read_lists(spark, path).select(
        "customer_id", F.concat_ws(",", "items").alias("items")
    )


def _items_roundtrip(spark, folder):
    path = new_path(spark, "catalogue")
    Case(spark, folder).items.write.parquet(path)
    return tidy(spark.read.parquet(path))


def _profile(table: str, ts: str | None, distinct: dict[str, str]):
    return lambda spark, folder: profile.table_profile(
        getattr(Case(spark, folder), table), ts, distinct
    )


_KEYS = {"customer_id": "n_customers", "item_id": "n_items"}

def _sketched_profile(spark, folder):
    """All months from stored sketches: exact rows and dates, distinct customers within five percent."""
    tx = Case(spark, folder).tx
    path = new_path(spark, "sketches")
    profile.monthly_sketches(tx, _TS, ["customer_id", "item_id"]).write.parquet(path)
    rough = profile.profile_of_sketches(spark.read.parquet(path), {"customer_id": "customers", "item_id": "items"})
    exact = profile.table_profile(tx, distinct={"customer_id": "n_customers", "item_id": "n_items"}).drop("n_rows")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    return side_by_side(rough, exact).select(
        "n_rows", "date_min", "date_max", "n_customers", "n_items",
        (close("customers", "n_customers") & close("items", "n_items")).alias("close"),
    )


QUERIES = {
    "profile_sketches": _sketched_profile,
    "scan_transactions": _scan("tx"),
    "scan_events": _scan("events"),
    "scan_items": _scan("items"),
    "preview": lambda spark, folder: tidy(profile.preview(Case(spark, folder).tx)),
    "split_transactions": _split_transactions(split.SplitRule()),
    "split_transactions_y2000": _split_transactions(_YEAR),
    "split_events": _split_events,
    "split_stats": _split_stats(split.SplitRule()),
    "split_stats_y2000": _split_stats(_YEAR),
    "history_window_by_target": _history_window,
    "profile_transactions": _profile("tx", _TS, _KEYS),
    "profile_events": _profile("events", "event_date", _KEYS | {"event_type": "n_types"}),
    "profile_items": _profile("items", None, {"item_id": "n_items"}),
    "event_type_counts": lambda spark, folder: profile.value_counts(
        Case(spark, folder).events, "event_type"
    ),
    "category_counts": lambda spark, folder: profile.value_counts(
        Case(spark, folder).items, "category_l1"
    ),
    "monthly_distribution": lambda spark, folder: profile.monthly_distribution(
        Case(spark, folder).tx, _TS
    ),
    "active_items": lambda spark, folder: Case(spark, folder).active,
    "history_for_users": lambda spark, folder: tidy(
        split.of_customers(Case(spark, folder).train, Case(spark, folder).val_customers)
    ),
    "known_target_users": lambda spark, folder: Case(spark, folder).known_customers,
    "first_n_users": lambda spark, folder: _first_customers(Case(spark, folder)),
    "sample_users": lambda spark, folder: hash_take(
        stage(split.customers_of(Case(spark, folder).train), "everyone"),
        ["customer_id"],
        500,
        seed=7,
    ),
    "interactions": lambda spark, folder: tidy(inter.interactions(Case(spark, folder).train)),
    "interactions_with_events": lambda spark, folder: tidy(
        inter.interactions(
            Case(spark, folder).train,
            split.take(Case(spark, folder).events, "event_date", rule=_EVENT_YEAR),
        )
    ),
    "interaction_density": lambda spark, folder: tidy(
        inter.density(inter.interactions(Case(spark, folder).train))
    ),
    "user_index": lambda spark, folder: inter.key_index(Case(spark, folder).train, "customer_id"),
    "item_index": lambda spark, folder: inter.key_index(Case(spark, folder).train, "item_id"),
    "item_index_part": lambda spark, folder: inter.key_index(
        Case(spark, folder, "part").train, "item_id"
    ),
    "predictions_sink": _predictions_sink,
    "ground_truth_lists": _ground_truth,
    "resume_remaining_users": _resume,
    "rerun_replaces_lists": _rerun,
    "items_roundtrip": _items_roundtrip,
}

_SPLIT_CASE = """CASE WHEN month({ts}) BETWEEN 1 AND 10 THEN 'train'
            WHEN month({ts}) = 11 THEN 'val' ELSE 'test' END AS split"""


def _split_sql(where: str = "true") -> str:
    return sql(f"SELECT {_TX_SQL}, {_SPLIT_CASE.format(ts=_TS)} FROM tx WHERE {where}")


def _stats_sql(where: str = "true") -> str:
    return sql(
        f"""SELECT split, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers,
            count(DISTINCT item_id) AS n_items,
            {round_sql("count(*) * 100.0 / sum(count(*)) OVER ()", "pct")}
        FROM (SELECT *, {_SPLIT_CASE.format(ts=_TS)} FROM tx WHERE {where}) GROUP BY split"""
    )


def _profile_sql(table: str, ts: str | None, more: str) -> str:
    dates = f"min({ts}) AS date_min, max({ts}) AS date_max, " if ts else ""
    return sql(f"SELECT count(*) AS n_rows, {dates}{more} FROM {table}")


_KEYS_SQL = "count(DISTINCT customer_id) AS n_customers, count(DISTINCT item_id) AS n_items"
_HASH = "md5(concat_ws('|', CAST(customer_id AS VARCHAR), '{seed}'))"


def _take_sql(table: str, n: int, seed: int) -> str:
    order = f"{_HASH.format(seed=seed)}, customer_id"
    return f"SELECT customer_id FROM {table} QUALIFY row_number() OVER (ORDER BY {order}) <= {n}"


def _index_sql(key: str, by: str = "group") -> str:
    return sql(
        f"SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS idx "
        f"FROM (SELECT DISTINCT {key} FROM train)",
        base(by),
    )


_LISTS_SQL = sql(
    """SELECT CAST(u.customer_id AS VARCHAR) AS customer_id,
              coalesce(string_agg(p.item_id, ',' ORDER BY p.pos), '') AS items
    FROM val_customers u LEFT JOIN popular p ON u.customer_id = p.customer_id
    GROUP BY u.customer_id""",
    base(),
    POPULAR_SQL,
)

_SCAN_ITEMS = sql(
    f"SELECT item_id, sale_status, category_l1, category_l2, brand, {rounded('price')} FROM items"
)

SQL = {
    "profile_sketches": sql(
        """SELECT count(*) AS n_rows, min(updated_date) AS date_min, max(updated_date) AS date_max,
            count(DISTINCT customer_id) AS n_customers, count(DISTINCT item_id) AS n_items, TRUE AS close
        FROM tx"""
    ),
    "scan_transactions": sql(f"SELECT {_TX_SQL} FROM tx"),
    "preview": sql(f"SELECT {_TX_SQL} FROM tx ORDER BY {_TX} LIMIT 5"),
    "scan_events": sql("SELECT customer_id, item_id, event_type, event_date FROM ev"),
    "scan_items": _SCAN_ITEMS,
    "items_roundtrip": _SCAN_ITEMS,
    "split_transactions": _split_sql(),
    "split_transactions_y2000": _split_sql("year(updated_date) = 2000"),
    "split_events": sql(
        f"SELECT *, {_SPLIT_CASE.format(ts='event_date')} FROM ev WHERE year(event_date) = 2024"
    ),
    "split_stats": _stats_sql(),
    "split_stats_y2000": _stats_sql("year(updated_date) = 2000"),
    "history_window_by_target": _history_window_sql(),
    "profile_transactions": _profile_sql("tx", _TS, _KEYS_SQL),
    "profile_events": _profile_sql(
        "ev", "event_date", _KEYS_SQL + ", count(DISTINCT event_type) AS n_types"
    ),
    "profile_items": _profile_sql("items", None, "count(DISTINCT item_id) AS n_items"),
    "event_type_counts": sql("SELECT event_type, count(*) AS n FROM ev GROUP BY event_type"),
    "category_counts": sql("SELECT category_l1, count(*) AS n FROM items GROUP BY category_l1"),
    "monthly_distribution": sql(
        "SELECT CAST(month(updated_date) AS INTEGER) AS month, count(*) AS n FROM tx GROUP BY 1"
    ),
    "active_items": sql("SELECT item_id FROM active"),
    "history_for_users": sql(
        f"SELECT {_TX_SQL} FROM train WHERE customer_id IN (SELECT customer_id FROM val_customers)"
    ),
    "known_target_users": sql("SELECT customer_id FROM known_customers"),
    "first_n_users": sql(_take_sql("val_customers", 100, 42)),
    "sample_users": sql(_take_sql("(SELECT DISTINCT customer_id FROM train)", 500, 7)),
    "interactions": sql(
        "SELECT customer_id, item_id, CAST(sum(quantity) AS DOUBLE) AS weight "
        "FROM train GROUP BY ALL"
    ),
    "interactions_with_events": sql(
        """SELECT customer_id, item_id, CAST(sum(weight) AS DOUBLE) AS weight FROM (
            SELECT customer_id, item_id, CAST(quantity AS DECIMAL(18,4)) AS weight FROM train
            UNION ALL
            SELECT customer_id, item_id, CAST(CASE event_type WHEN 'purchase' THEN 1.0
                WHEN 'add_to_cart' THEN 0.4 WHEN 'wishlist' THEN 0.2 ELSE 0.1 END AS DECIMAL(18,4))
            FROM ev WHERE year(event_date) = 2024 AND month(event_date) BETWEEN 1 AND 10
              AND event_type IN ('purchase', 'add_to_cart', 'wishlist', 'view'))
        GROUP BY customer_id, item_id"""
    ),
    "interaction_density": sql(
        f"""SELECT *, {round_sql("100.0 * nnz / (n_customers * n_items)", "density_pct")} FROM (
            SELECT count(DISTINCT customer_id) AS n_customers,
                   count(DISTINCT item_id) AS n_items, count(*) AS nnz
            FROM (SELECT DISTINCT customer_id, item_id FROM train))"""
    ),
    "user_index": _index_sql("customer_id"),
    "item_index": _index_sql("item_id"),
    "item_index_part": _index_sql("item_id", "part"),
    "predictions_sink": _LISTS_SQL,
    "rerun_replaces_lists": _LISTS_SQL,
    "ground_truth_lists": sql(
        """SELECT CAST(customer_id AS VARCHAR) AS customer_id,
                  string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT customer_id, item_id FROM test) GROUP BY customer_id"""
    ),
    "resume_remaining_users": sql(
        "SELECT customer_id FROM val_customers WHERE customer_id NOT IN "
        f"({_take_sql('val_customers', 100, 42)})"
    ),
}
