"""Candidate source 3: items near a customer's recent purchases in vector space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketrank.config import CandidateLimits, EmbeddingParams
from basketrank.functions.hashing import HashTables, top_k_by_hashing
from basketrank.functions.joins import lookup
from basketrank.functions.ordering import dense_index
from basketrank.functions.vectors import Kinds, top_k_by_dot, top_k_by_kind, unit, weighted_mean
from basketrank.models.skipgram import fit_skipgram


def purchase_sequences(
    transactions: DataFrame, max_length: int = EmbeddingParams.sentence_length, overlap: int = 0
) -> DataFrame:
    """(customer_id, chunk, items): purchases in time order, repeats kept.

    A history longer than ``max_length`` continues in further chunks, so no row
    grows with the data; each of them begins with the last ``overlap`` purchases of
    the one before. Positions come from one distributed ordering of all
    lines; a customer with a large share of them is spread over many tasks.
    """
    keys = ["customer_id", "updated_date", "item_id", "bill_id"]
    lines = dense_index(transactions.select(*keys), [F.col(k) for k in keys], "at")
    first = lines.groupBy("customer_id").agg(F.min("at").alias("first_at"))
    placed = lookup(lines, first, "customer_id", "inner", row_bytes=32, spread="at")
    # Chunks start every ``step`` purchases; within the overlap a purchase is in two.
    step = max(1, max_length - overlap)
    pos = F.col("at") - F.col("first_at")
    last = F.floor(pos / step).cast("int")
    both = (pos % step < max_length - step) & (last > 0)
    return (
        placed.select(
            "customer_id",
            F.explode(F.when(both, F.array(last - 1, last)).otherwise(F.array(last))).alias("chunk"),
            F.struct("at", "item_id").alias("step"),
        )
        .groupBy("customer_id", "chunk")
        .agg(F.array_sort(F.collect_list("step"))["item_id"].alias("items"))
    )


def fit_item_vectors(
    transactions: DataFrame, params: EmbeddingParams = EmbeddingParams()
) -> DataFrame:
    """(item_id, vec): skip-gram vectors of items from the purchase sequences."""

    def sequences(lines: DataFrame) -> DataFrame:
        # A purchase is in two chunks at most.
        return purchase_sequences(lines, max(params.sentence_length, 2 * params.window), params.window)

    return fit_skipgram(transactions, sequences, params)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length 1."""
    return unit(vectors)


def customer_vectors(
    history: DataFrame,
    vectors: DataFrame,
    n_recent: int = CandidateLimits.recent_items,
    decay: float = CandidateLimits.decay,
    *,
    dims: int = EmbeddingParams.vector_size,
    limit_bytes: int | None = None,
    kinds: Kinds | None = None,
) -> DataFrame:
    """(customer_id, vec): decayed mean of the most recent items, length 1.

    The first ``n_recent`` history items are taken, then those without a vector
    dropped, and the weights 1, decay, decay^2, ... go to the remaining ones.
    ``history`` needs gapless positions. Customers without a vector are absent.
    Where many items of a large catalogue share a vector, only the numbers of the
    ``kinds`` travel, and the few different vectors come to the customers.
    """
    kinds = kinds or Kinds.of(vectors, dims, limit_bytes)
    recent = history.filter(F.col("pos") <= n_recent).select("customer_id", "item_id", "pos")
    found = lookup(
        recent, vectors.select("item_id", "vec") if kinds is None else kinds.items.select("item_id", "kind"),
        "item_id", "inner",
        row_bytes=64 if kinds else dims * 8 + 64, limit_bytes=limit_bytes, spread="customer_id",
    )
    # At most n_recent rows per customer.
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy("pos")) - 1
    weighted = found.withColumn("weight", F.pow(F.lit(decay), place))
    if kinds is not None:
        weighted = weighted.join(F.broadcast(kinds.vecs), "kind")
    means = weighted_mean(weighted, "customer_id", "weight")
    return unit(means.filter(F.exists("vec", lambda x: x != 0)))


def vector_candidates(
    history: DataFrame,
    vectors: DataFrame,
    n: int = CandidateLimits.vectors,
    n_recent: int = CandidateLimits.recent_items,
    decay: float = CandidateLimits.decay,
    *,
    dims: int = EmbeddingParams.vector_size,
    tables: HashTables | None = None,
    **product,
) -> DataFrame:
    """(customer_id, item_id, score, pos): items with the highest cosine, history excluded.

    Exact, unless hash ``tables`` are given, which save looking at every item of a
    very large catalogue and may miss some.
    """
    kinds = Kinds.of(vectors, dims, product.get("limit_bytes")) if tables is None else None
    queries = customer_vectors(history, vectors, n_recent, decay, dims=dims, kinds=kinds)
    seen = history.select("customer_id", "item_id")
    if tables is not None:
        return top_k_by_hashing(queries, unit_vectors(vectors), n, seen, dims=dims, tables=tables)
    if kinds is not None:
        scaled = Kinds(kinds.items, unit_vectors(kinds.vecs), kinds.n)
        found = top_k_by_kind(queries, scaled, n, seen, product.get("limit_bytes"))
        if found is not None:
            return found
    return top_k_by_dot(queries, unit_vectors(vectors), n, seen, dims=dims, one_each=True, **product)
