"""Candidate sources and their merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketrank.functions.hashing import top_k_by_hashing
from basketrank.functions.staging import new_path, stage
from basketrank.functions.vectors import top_k_by_dot
from basketrank.operators import covisit, embedding
from basketrank.operators.candidates import merge_candidates
from basketrank.operators.history import history_candidates
from basketrank.operators.split import only_items
from basketrank.queries.common import (
    COVISIT,
    CUSTOMER_VECTORS,
    HISTORY,
    NEAREST,
    VECTORS,
    Case,
    base,
    merged,
    neighbours,
    round_sql,
    rounded,
    sql,
    tidy,
    with_all_candidates,
)
from basketrank.sources import star


def _history(by: str, max_items: int = 200):
    return lambda spark, folder: history_candidates(Case(spark, folder, by).train, max_items)


def _covisit_matrix(by: str, max_bill: int | None = 20):
    return lambda spark, folder: covisit.covisit_neighbours(
        Case(spark, folder, by).train, max_bill=max_bill
    )


# Whole bills and every partner of an item.
_WHOLE = {"per_item": None, "max_bill": None}


def _covisit_roundtrip(spark, folder):
    path = new_path(spark, "neighbours")
    Case(spark, folder).neighbours(**_WHOLE).write.parquet(path)
    return spark.read.parquet(path)


def _sequences(spark, folder):
    rows = embedding.purchase_sequences(Case(spark, folder).train)
    return rows.select("customer_id", "chunk", F.concat_ws(",", "items").alias("items"))


def _unit(spark, folder):
    rows = embedding.unit_vectors(star.embedding_rows(spark, folder))
    return tidy(rows.select("vec_id", F.posexplode("vec").alias("d", "x")))


def _nearest_rows(limit_bytes: int | None = None):
    """For every embedding the ten others with the largest dot product."""

    def run(spark, folder):
        rows = stage(star.embedding_rows(spark, folder), "rows")
        return top_k_by_dot(
            rows.select(F.col("vec_id").alias("customer_id"), "vec"),
            rows.select(F.col("vec_id").cast("string").alias("item_id"), "vec"),
            10,
            rows.select(F.col("vec_id").alias("customer_id"), F.col("vec_id").cast("string").alias("item_id")),
            dims=64, limit_bytes=limit_bytes, customers_per_block=200, items_per_block=120,
        )

    return run


def _hashed_recall(spark, folder):
    """How much of the ten nearest of every embedding the hash tables find, exact scores included."""
    rows = stage(embedding.unit_vectors(star.embedding_rows(spark, folder)), "rows")
    asks = rows.select(F.col("vec_id").alias("customer_id"), "vec")
    items = rows.select(F.col("vec_id").cast("string").alias("item_id"), "vec")
    own = rows.select(F.col("vec_id").alias("customer_id"), F.col("vec_id").cast("string").alias("item_id"))
    exact = top_k_by_dot(asks, items, 10, own, dims=64)
    found = top_k_by_hashing(asks, items, 10, own, dims=64).withColumnRenamed("score", "found_score")
    both = exact.drop("pos").join(found.drop("pos"), ["customer_id", "item_id"], "left")
    return both.agg(
        F.count("*").alias("n_wanted"),
        (F.count("found_score") >= 0.9 * F.count("*")).alias("nine_tenths_found"),
        F.count_if(F.col("score") != F.col("found_score")).alias("n_other_scores"),
    )


def _vectors_roundtrip(spark, folder):
    path = new_path(spark, "vectors")
    Case(spark, folder, "part").vectors.write.parquet(path)
    return tidy(spark.read.parquet(path).select("item_id", F.posexplode("vec").alias("d", "x")))


def _customer_vectors(by: str):
    def run(spark, folder):
        case = Case(spark, folder, by)
        rows = embedding.customer_vectors(case.history(), case.vectors)
        return tidy(rows.select("customer_id", F.posexplode("vec").alias("d", "x")))

    return run


def _nearest(by: str):
    def run(spark, folder):
        case = Case(spark, folder, by)
        return tidy(embedding.vector_candidates(case.history(), case.vectors))

    return run


def _merge(spark, folder):
    """A list of 40 per customer, so that the total limit takes effect."""
    case = Case(spark, folder, once=True)
    history = case.history()
    near = stage(case.neighbours(), "neighbours")
    bought_together = covisit.covisit_candidates(history, near)
    return tidy(merge_candidates(history, only_items(bought_together, case.active), total=40))


def _generate(by: str):
    return lambda spark, folder: tidy(Case(spark, folder, by, once=True).candidates())


QUERIES = {
    "history_candidates": _history("group"),
    "history_candidates_cap20": _history("group", 20),
    "history_candidates_part": _history("part"),
    "covisit_matrix": _covisit_matrix("group"),
    "covisit_matrix_cap5": _covisit_matrix("group", 5),
    "covisit_matrix_part": _covisit_matrix("part"),
    "covisit_matrix_uncapped": _covisit_matrix("group", None),
    "covisit_input_stats": lambda spark, folder: covisit.bill_stats(
        covisit.bill_items(Case(spark, folder).train)
    ),
    "covisit_roundtrip": _covisit_roundtrip,
    "covisit_candidates": lambda spark, folder: Case(spark, folder).covisit(),
    "covisit_candidates_part": lambda spark, folder: Case(spark, folder, "part").covisit(**_WHOLE),
    "purchase_sequences": _sequences,
    "unit_embeddings": _unit,
    "vectors_roundtrip": _vectors_roundtrip,
    "top_dot_embeddings": _nearest_rows(),
    "top_dot_embeddings_blocks": _nearest_rows(0),
    "hashed_recall": _hashed_recall,
    "decayed_user_vector": _customer_vectors("group"),
    "decayed_user_vector_part": _customer_vectors("part"),
    "knn_cosine": _nearest("group"),
    "knn_cosine_part": _nearest("part"),
    "merge_candidates": _merge,
    "generate_candidates": _generate("group"),
    "generate_candidates_part": _generate("part"),
}


def _history_sql(by: str, max_items: int = 200) -> str:
    return sql(
        "SELECT customer_id, item_id, last_date, CAST(pos AS INTEGER) AS pos "
        f"FROM history_all WHERE pos <= {max_items}",
        base(by),
        HISTORY,
    )


_NEIGHBOURS = "SELECT item_id, co_item_id, score, CAST(rn AS INTEGER) AS rn FROM neighbours"
_COVISIT = "SELECT customer_id, item_id, score, CAST(pos AS INTEGER) AS pos FROM covisit"
_CELLS = "SELECT {key}, CAST(d - 1 AS INTEGER) AS d, {x} FROM {table}"
_NEAREST = "SELECT customer_id, item_id, score, CAST(pos AS INTEGER) AS pos FROM nearest"
_CANDIDATES = (
    "SELECT customer_id, item_id, from_history, from_covisit, from_w2v, "
    f"{rounded('covisit_score')}, w2v_score, CAST(pos AS INTEGER) AS pos FROM candidates"
)


def _customer_sql(by: str) -> str:
    select = _CELLS.format(key="customer_id", x=rounded("x"), table="customer_cells")
    return sql(select, base(by), HISTORY, VECTORS, CUSTOMER_VECTORS)


def _nearest_sql(by: str) -> str:
    return sql(_NEAREST, base(by), HISTORY, VECTORS, CUSTOMER_VECTORS, NEAREST)


_ALL_CELLS = """
all_cells AS (
    SELECT vec_id, unnest(range(0, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x
    FROM embeddings)"""

_TOP_DOT = sql(
    """SELECT customer_id, item_id, score, CAST(pos AS INTEGER) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_id) AS pos FROM (
            SELECT a.vec_id AS customer_id, CAST(b.vec_id AS VARCHAR) AS item_id,
                   round(sum(a.x * b.x), 9) + 0.0 AS score
            FROM all_cells a JOIN all_cells b ON a.d = b.d AND a.vec_id <> b.vec_id GROUP BY ALL))
    WHERE pos <= 10""",
    _ALL_CELLS,
)


SQL = {
    "history_candidates": _history_sql("group"),
    "history_candidates_cap20": _history_sql("group", 20),
    "history_candidates_part": _history_sql("part"),
    "covisit_matrix": sql(_NEIGHBOURS, base(), neighbours()),
    "covisit_matrix_cap5": sql(_NEIGHBOURS, base(), neighbours(5)),
    "covisit_matrix_part": sql(_NEIGHBOURS, base("part"), neighbours()),
    "covisit_matrix_uncapped": sql(_NEIGHBOURS, base(), neighbours(1_000_000)),
    "covisit_input_stats": sql(
        "SELECT count(DISTINCT bill_id) AS n_bills, count(DISTINCT item_id) AS n_items, "
        "count(*) AS n_pairs FROM bill_cut",
        base(),
        neighbours(),
    ),
    "covisit_roundtrip": sql(_NEIGHBOURS, base(), neighbours(None, None)),
    "covisit_candidates": sql(_COVISIT, base(), HISTORY, neighbours(), COVISIT),
    "covisit_candidates_part": sql(_COVISIT, base("part"), HISTORY, neighbours(None, None), COVISIT),
    "purchase_sequences": sql(
        "SELECT customer_id, CAST(0 AS INTEGER) AS chunk, "
        "string_agg(item_id, ',' ORDER BY updated_date, item_id) AS items "
        "FROM train GROUP BY customer_id"
    ),
    "unit_embeddings": sql(
        "SELECT c.vec_id, CAST(c.d AS INTEGER) AS d, " + round_sql("c.x / n", "x")
        + " FROM all_cells c JOIN (SELECT vec_id, sqrt(sum(x * x)) AS n FROM all_cells GROUP BY ALL) l "
        "ON c.vec_id = l.vec_id",
        _ALL_CELLS,
    ),
    "vectors_roundtrip": sql(
        _CELLS.format(key="item_id", x=rounded("x"), table="cells"), base("part"), VECTORS
    ),
    "top_dot_embeddings": _TOP_DOT,
    "top_dot_embeddings_blocks": _TOP_DOT,
    "hashed_recall": "SELECT CAST(count(*) * 10 AS BIGINT) AS n_wanted, TRUE AS nine_tenths_found, "
    "CAST(0 AS BIGINT) AS n_other_scores FROM embeddings",
    "decayed_user_vector": _customer_sql("group"),
    "decayed_user_vector_part": _customer_sql("part"),
    "knn_cosine": _nearest_sql("group"),
    "knn_cosine_part": _nearest_sql("part"),
    "merge_candidates": sql(
        _CANDIDATES, base(), HISTORY, neighbours(), COVISIT, merged(40, with_vectors=False)
    ),
    "generate_candidates": sql(_CANDIDATES, *with_all_candidates()),
    "generate_candidates_part": sql(_CANDIDATES, *with_all_candidates("part")),
}
