"""Inputs shared by the queries, and the common table expressions of the twins."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from basketrank.functions.ordering import renumber
from basketrank.functions.staging import parts_for, stage
from basketrank.operators import split
from basketrank.operators.candidates import generate_candidates
from basketrank.operators.covisit import covisit_candidates, covisit_neighbours
from basketrank.operators.history import history_candidates
from basketrank.sources import star

# Six decimal places.
SCALE = 1e6
COSINES = ("score", "w2v_score", "ui_w2v_score")


class Case:
    """The logical tables of one folder and the usual steps on them.

    ``once`` stages the purchase lines, for queries that read them many times.
    """

    def __init__(
        self, spark: SparkSession, folder: str, by: str = star.GROUP, once: bool = False
    ) -> None:
        self.spark = spark
        self.folder = folder
        self.by = by
        self.once = once

    @cached_property
    def tx(self) -> DataFrame:
        rows = star.transactions(self.spark, self.folder, self.by)
        return stage(rows, "transactions") if self.once else rows

    @cached_property
    def items(self) -> DataFrame:
        return star.items(self.spark, self.folder, self.by)

    @cached_property
    def events(self) -> DataFrame:
        return star.events(self.spark, self.folder)

    @cached_property
    def vectors(self) -> DataFrame:
        return stage(star.item_vectors(self.spark, self.folder, self.by), "vectors")

    def part(self, name: str) -> DataFrame:
        return split.take(self.tx, "updated_date", (name,))

    @cached_property
    def train(self) -> DataFrame:
        return self.part(split.TRAIN)

    @cached_property
    def val(self) -> DataFrame:
        return self.part(split.VAL)

    @cached_property
    def active(self) -> DataFrame:
        return split.active_items(self.items)

    @cached_property
    def val_customers(self) -> DataFrame:
        return stage(split.customers_of(self.val), "customers")

    @cached_property
    def known_customers(self) -> DataFrame:
        return stage(split.known_customers(self.val, self.train), "known")

    def history(self) -> DataFrame:
        """Cut and filtered history of the validation customers; staged, and the customers sent out once."""
        mine = stage(history_candidates(split.of_customers(self.train, self.val_customers)), "history")
        return stage(renumber(split.only_items(mine, self.active), "customer_id"), "own-history")

    def neighbours(self, **limits) -> DataFrame:
        return covisit_neighbours(self.train, **limits)

    def covisit(self, **limits) -> DataFrame:
        near = stage(self.neighbours(**limits), "neighbours")
        return covisit_candidates(self.history(), near, parts=parts_for(self.train))

    def candidates(self) -> DataFrame:
        return generate_candidates(
            self.train,
            self.val_customers,
            stage(self.neighbours(), "neighbours"),
            self.vectors,
            self.active,
        )


def tidy(df: DataFrame) -> DataFrame:
    """Decimals as doubles, and doubles rounded in a way both engines share.

    round() treats halves differently in the two, floor() does not. Cosines are
    left alone: the operator has rounded them already.
    """
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if field.name not in COSINES and isinstance(field.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            column = (F.floor(column.cast("double") * SCALE + 0.5) / SCALE).alias(field.name)
        out.append(column)
    return df.select(*out)


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of two tables of one row each in one row, without a join of everything with everything."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def round_sql(expr: str, name: str) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * {SCALE} + 0.5) / {SCALE} + 0.0 AS {name}"


def rounded(*names: str) -> str:
    return ", ".join(round_sql(n, n) for n in names)


_ITEM = {"group": "concat(p_brand, '|', p_type)", "part": "CAST(p_partkey AS VARCHAR)"}

_ITEMS = {
    "group": """
    SELECT concat(p_brand, '|', p_type) AS item_id,
           CASE WHEN CAST(split_part(p_brand, '#', 2) AS INTEGER) % 10 = 0 THEN 0 ELSE 1 END AS sale_status,
           p_type AS category_l1,
           concat(p_type, '/', CAST(split_part(p_brand, '#', 2) AS INTEGER) % 5) AS category_l2,
           p_brand AS brand,
           CAST(min(p_retailprice) AS DECIMAL(12,2)) AS price
    FROM part GROUP BY p_brand, p_type""",
    "part": """
    SELECT CAST(p_partkey AS VARCHAR) AS item_id,
           CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS sale_status,
           p_type AS category_l1,
           CASE WHEN p_size % 13 = 0 THEN NULL ELSE concat(p_type, '/', p_size % 5) END AS category_l2,
           p_brand AS brand,
           CAST(p_retailprice AS DECIMAL(12,2)) AS price
    FROM part""",
}

_VECTORS = {
    "group": """
    SELECT item_id, list(x ORDER BY d) AS embedding FROM (
        SELECT s.item_id, d, avg(x) AS x FROM slots s JOIN (
            SELECT vec_id % (SELECT count(*) FROM slots) AS slot,
                   unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x
            FROM embeddings) e ON s.slot = e.slot
        GROUP BY ALL)
    GROUP BY item_id""",
    "part": "SELECT CAST(p_partkey AS VARCHAR) AS item_id, e.embedding "
    "FROM embeddings e JOIN part ON e.vec_id = p_partkey % (SELECT count(*) FROM embeddings)",
}


def base(by: str = "group") -> str:
    """The logical tables and the parts."""
    return f"""
tx AS (
    SELECT CAST(o_custkey AS INTEGER) AS customer_id, {_ITEM[by]} AS item_id,
           l_orderkey AS bill_id, CAST(l_quantity AS INTEGER) AS quantity,
           CAST(p_retailprice AS DECIMAL(12,2)) AS price,
           CAST(l_discount AS DECIMAL(4,2)) AS discount, o_orderdate AS updated_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
items AS ({_ITEMS[by]}),
slots AS (
    SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS slot
    FROM (SELECT DISTINCT concat(p_brand, '|', p_type) AS item_id FROM part)),
ev AS (
    SELECT CAST(user_id AS INTEGER) AS customer_id, s.item_id, event_type, ts AS event_date
    FROM events JOIN slots s ON s.slot = CAST(json_extract_string(props, '$.k') AS INTEGER)),
vectors AS ({_VECTORS[by]}),
train AS (SELECT * FROM tx WHERE month(updated_date) BETWEEN 1 AND 10),
val AS (SELECT * FROM tx WHERE month(updated_date) = 11),
test AS (SELECT * FROM tx WHERE month(updated_date) = 12),
active AS (SELECT item_id FROM items WHERE sale_status = 1),
val_customers AS (SELECT DISTINCT customer_id FROM val),
known_customers AS (
    SELECT customer_id FROM val_customers WHERE customer_id IN (SELECT customer_id FROM train))"""


HISTORY = """
recency AS (
    SELECT customer_id, item_id, max(updated_date) AS last_date FROM train GROUP BY ALL),
history_all AS (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY last_date DESC, item_id) AS pos
    FROM recency QUALIFY pos <= 200),
history AS (
    SELECT customer_id, item_id, last_date,
           row_number() OVER (PARTITION BY customer_id ORDER BY pos) AS pos
    FROM history_all
    WHERE customer_id IN (SELECT customer_id FROM val_customers)
      AND item_id IN (SELECT item_id FROM active))"""


def neighbours(per_bill: int | None = 20, per_item: int | None = 50) -> str:
    """None lifts a limit."""
    bill_limit = f"QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY item_id) <= {per_bill}" if per_bill else ""
    item_limit = f"QUALIFY rn <= {per_item}" if per_item else ""
    return f"""
bill_cut AS (
    SELECT bill_id, item_id FROM (SELECT DISTINCT bill_id, item_id FROM train)
    {bill_limit}),
pairs AS (
    SELECT a.item_id, b.item_id AS co_item_id, count(*) AS score
    FROM bill_cut a JOIN bill_cut b ON a.bill_id = b.bill_id AND a.item_id <> b.item_id
    GROUP BY ALL),
neighbours AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, co_item_id) AS rn
    FROM pairs {item_limit})"""


COVISIT = """
covisit_sums AS (
    SELECT h.customer_id, n.co_item_id AS item_id, CAST(sum(n.score) AS BIGINT) AS score
    FROM history h JOIN neighbours n ON h.item_id = n.item_id GROUP BY ALL),
covisit AS (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_id) AS pos
    FROM covisit_sums c
    WHERE NOT EXISTS (SELECT 1 FROM history h
                      WHERE h.customer_id = c.customer_id AND h.item_id = c.item_id)
    QUALIFY pos <= 300)"""

VECTORS = """
cells AS (
    SELECT item_id, unnest(range(1, len(embedding) + 1)) AS d,
           CAST(unnest(embedding) AS DOUBLE) AS x FROM vectors),
lengths AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY item_id),
unit_cells AS (
    SELECT c.item_id, c.d, c.x / CASE WHEN l.n = 0 THEN 1 ELSE l.n END AS x
    FROM cells c JOIN lengths l ON c.item_id = l.item_id)"""

CUSTOMER_VECTORS = """
recent AS (
    SELECT customer_id, item_id,
           row_number() OVER (PARTITION BY customer_id ORDER BY pos) - 1 AS i
    FROM history WHERE pos <= 20 AND item_id IN (SELECT item_id FROM vectors)),
weights AS (
    SELECT customer_id, item_id,
           pow(0.9, i) / sum(pow(0.9, i)) OVER (PARTITION BY customer_id) AS w FROM recent),
sums AS (
    SELECT w.customer_id, c.d, sum(w.w * c.x) AS x
    FROM weights w JOIN cells c ON w.item_id = c.item_id GROUP BY ALL),
customer_cells AS (
    SELECT s.customer_id, s.d, s.x / l.n AS x
    FROM sums s JOIN (SELECT customer_id, sqrt(sum(x * x)) AS n FROM sums GROUP BY ALL) l
      ON s.customer_id = l.customer_id
    WHERE l.n > 0)"""

NEAREST = """
cosines AS (
    SELECT q.customer_id, u.item_id, round(sum(q.x * u.x), 9) + 0.0 AS score
    FROM customer_cells q JOIN unit_cells u ON q.d = u.d GROUP BY ALL),
nearest AS (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_id) AS pos
    FROM cosines c
    WHERE NOT EXISTS (SELECT 1 FROM history h
                      WHERE h.customer_id = c.customer_id AND h.item_id = c.item_id)
    QUALIFY pos <= 200)"""


def merged(total: int = 1200, with_vectors: bool = True) -> str:
    vectors = """
    UNION ALL
    SELECT customer_id, item_id, 2, pos, score FROM nearest
    WHERE item_id IN (SELECT item_id FROM active)"""
    return f"""
named AS (
    SELECT customer_id, item_id, 0 AS source, pos, 0.0 AS score FROM history
    UNION ALL
    SELECT customer_id, item_id, 1, pos, CAST(score AS DOUBLE) FROM covisit
    WHERE item_id IN (SELECT item_id FROM active){vectors if with_vectors else ""}),
grouped AS (
    SELECT customer_id, item_id, min(source * 1000000 + pos) AS place,
           CAST(max(CASE WHEN source = 0 THEN 1 ELSE 0 END) AS INTEGER) AS from_history,
           CAST(max(CASE WHEN source = 1 THEN 1 ELSE 0 END) AS INTEGER) AS from_covisit,
           CAST(max(CASE WHEN source = 2 THEN 1 ELSE 0 END) AS INTEGER) AS from_w2v,
           max(CASE WHEN source = 1 THEN score END) AS covisit_score,
           max(CASE WHEN source = 2 THEN score END) AS w2v_score
    FROM named GROUP BY customer_id, item_id),
candidates AS (
    SELECT * EXCLUDE (place),
           row_number() OVER (PARTITION BY customer_id ORDER BY place) AS pos
    FROM grouped QUALIFY pos <= {total})"""


def with_all_candidates(by: str = "group") -> tuple[str, ...]:
    return (
        base(by), HISTORY, neighbours(), COVISIT, VECTORS, CUSTOMER_VECTORS, NEAREST, merged()
    )


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes or (base(),)) + "\n" + select
