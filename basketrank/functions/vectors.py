"""Vectors as ``array<double>`` columns, and exact top-k by dot product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from basketrank.functions.joins import BROADCAST_BYTES, fits_broadcast, lookup
from basketrank.functions.ordering import dense_index, dense_index_sized, top_n
from basketrank.functions.staging import read_batches, stage

# Scores are compared after rounding, so that the order of additions inside a
# dot product cannot change a ranking.
SCORE_DIGITS = 9

# Customers that a task holds at a time, and items it reads at a time, when the
# catalogue is too large to broadcast.
CUSTOMERS_PER_BLOCK = 16_384
ITEMS_PER_BLOCK = 65_536

# Scores held at once by one task: 256k doubles, 2 MB, and a few tables of that size beside them.
_CELLS = 262_144


def unit(df: DataFrame, column: str = "vec") -> DataFrame:
    """Scale the vectors of a column to length 1; zero vectors stay as they are."""
    dense = df.withColumn("_vector", array_to_vector(column))
    scaled = Normalizer(p=2.0, inputCol="_vector", outputCol="_unit").transform(dense)
    return scaled.withColumn(column, vector_to_array("_unit")).drop("_vector", "_unit")


def weighted_mean(df: DataFrame, group: str, weight: str, column: str = "vec") -> DataFrame:
    """(group, column): weighted mean vector of each group, with partial sums per task."""
    dense = df.withColumn("_vector", array_to_vector(column))
    mean = Summarizer.mean(F.col("_vector"), F.col(weight))
    return dense.groupBy(group).agg(mean.alias("_mean")).select(
        group, vector_to_array("_mean").alias(column)
    )


def _best(
    vecs: np.ndarray, seen: pa.Array, names: pa.Array, matrix: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, score) of the ``k`` best unseen items of each row, ties to the smaller place; ``names`` are sorted."""
    # Adding 0.0 turns -0.0 into 0.0.
    scores = np.round(vecs @ matrix.T, SCORE_DIGITS) + 0.0
    flat = seen.flatten()
    if len(flat):
        lengths = pc.fill_null(pc.list_value_length(seen), 0).to_numpy(zero_copy_only=False)
        at = pc.index_in(flat.cast(names.type), value_set=names, skip_nulls=True)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        scores[rows[known], at.drop_null().to_numpy()] = -np.inf
    n = min(k, len(names))
    kth = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
    row, place = np.nonzero((scores >= kth) & np.isfinite(scores))
    return _keep_best(row, place, scores[row, place], k)


@dataclass(frozen=True)
class Kinds:
    """A catalogue in which many items have the same vector.

    ``items`` is (item_id, at, kind), numbered in item order, ``vecs`` (kind, vec) with
    every different vector once; both are stored.
    """

    items: DataFrame
    vecs: DataFrame
    n: int

    @classmethod
    def of(cls, items: DataFrame, dims: int, limit_bytes: int | None = None) -> Kinds | None:
        """None where the different vectors are too many to broadcast, or all items are not."""
        if fits_broadcast(items, dims * 8, limit_bytes):
            return None
        limit = BROADCAST_BYTES if limit_bytes is None else limit_bytes
        vecs, n = dense_index_sized(items.select("vec").distinct(), [F.col("vec")], "kind")
        if n * dims * 8 > limit:
            return None
        vecs = stage(vecs.select(F.col("kind").cast("int"), "vec"), "kinds")
        named = items.select("item_id", "vec").join(F.broadcast(vecs), "vec").select("item_id", "kind")
        return cls(stage(dense_index(named, [F.col("item_id")], "at"), "catalogue"), vecs, n)


def top_k_by_kind(
    queries: DataFrame, kinds: Kinds, k: int, seen: DataFrame, limit_bytes: int | None = None
) -> DataFrame | None:
    """As :func:`top_k_by_dot`, but every different vector is scored once.

    The items of one vector have one score, so of each kind only the first ones in item
    order can be in a list: ``k``, and as many more as the longest list of seen items.
    These are broadcast; None where they are too many. ``queries`` has one row per customer.
    """
    known = lookup(
        seen.select("customer_id", "item_id"), kinds.items.select("item_id", "at"), "item_id", "inner",
        row_bytes=64, spread="customer_id", limit_bytes=limit_bytes,
    )
    lists = stage(known.groupBy("customer_id").agg(F.collect_set("at").alias("seen")), "seen")
    longest = lists.agg(F.max(F.size("seen"))).first()[0] or 0
    firsts = stage(top_n(kinds.items, "kind", [F.col("at")], k + longest, "_nth").drop("_nth"), "first-of-kind")
    if not fits_broadcast(firsts, 64, limit_bytes):
        return None
    held = firsts.orderBy("kind", "at").toArrow()  # size checked above
    names = pa.concat_arrays(held.column("item_id").chunks)
    at = held.column("at").to_numpy()
    ends = np.cumsum(np.bincount(held.column("kind").to_numpy(), minlength=kinds.n))
    of = kinds.vecs.orderBy("kind").toArrow()
    matrix = np.concatenate([_lists_matrix(c) for c in of.column("vec").chunks if len(c)])
    shared = queries.sparkSession.sparkContext.broadcast((names, at, np.concatenate([[0], ends]), matrix))
    customer, item = queries.schema["customer_id"].dataType, kinds.items.schema["item_id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, starts, matrix = shared.value
        step = max(1, _CELLS // len(matrix))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                row, place, scores = _best_of_kinds(_lists_matrix(some.column(1)), some.column(2), at, starts, matrix, k)
                yield _ranked(some.column(0), names, row, place, scores)

    rows = queries.select("customer_id", "vec").join(lists, "customer_id", "left")
    return rows.mapInArrow(
        score, f"customer_id {customer.simpleString()}, item_id {item.simpleString()}, score double, pos int"
    )


def _ranked(
    customers: pa.Array, names: pa.Array, row: np.ndarray, place: np.ndarray, scores: np.ndarray
) -> pa.RecordBatch:
    """Rows sorted by customer and rank, numbered from 1 per customer."""
    pos = np.arange(1, len(row) + 1) - np.searchsorted(row, row, side="left")
    return pa.RecordBatch.from_arrays(
        [customers.take(pa.array(row)), names.take(pa.array(place)), pa.array(scores), pa.array(pos.astype(np.int32))],
        ["customer_id", "item_id", "score", "pos"],
    )


def _lists_matrix(column: pa.Array) -> np.ndarray:
    if column.null_count or pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors must have one length and not be null")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best_of_kinds(
    vecs: np.ndarray, seen: pa.Array, at: np.ndarray, starts: np.ndarray, matrix: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``at``, score) of the ``k`` best unseen items of each row, ties to the smaller item."""
    # Adding 0.0 turns -0.0 into 0.0.
    scores = np.round(vecs @ matrix.T, SCORE_DIGITS) + 0.0
    scores[~np.isfinite(scores)] = -np.inf
    lengths = np.diff(seen.offsets.to_numpy())
    # So many kinds hold enough items, whichever they are.
    sizes = np.diff(starts)
    enough = np.cumsum(np.sort(sizes)) < k + lengths.max(initial=0)
    m = min(int(enough.sum()) + 1, len(matrix))
    kth = -np.partition(-scores, m - 1, axis=1)[:, m - 1 : m]
    row, kind = np.nonzero((scores >= kth) & np.isfinite(scores))
    value, counts = scores[row, kind], sizes[kind]
    place = np.arange(counts.sum()) + np.repeat(starts[kind] - (np.cumsum(counts) - counts), counts)
    row, value = np.repeat(row, counts), np.repeat(value, counts)
    asked = np.repeat(np.arange(len(lengths)), lengths)
    width = int(at.max(initial=0)) + 1
    mine = seen.flatten().to_numpy(zero_copy_only=False)
    free = ~np.isin(row * width + at[place], (asked * width + mine)[mine < width])
    row, place, value = row[free], place[free], value[free]
    row, place, value = _keep_best(row, place, value, k, at)
    return row, place, value


def _result_schema(queries: DataFrame, items: DataFrame) -> str:
    types = dict(queries.dtypes) | {f"item.{n}": t for n, t in items.dtypes}
    return f"customer_id {types['customer_id']}, item_id {types['item.item_id']}, score double"


def _sorted_matrix(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Item names in order, and their vectors."""
    table = table.sort_by("item_id").combine_chunks()
    names, vecs = (pa.concat_arrays(table.column(c).chunks) for c in ("item_id", "vec"))
    return names, _lists_matrix(vecs)


def top_k_by_dot(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    seen: DataFrame | None = None,
    *,
    dims: int,
    limit_bytes: int | None = None,
    customers_per_block: int = CUSTOMERS_PER_BLOCK,
    items_per_block: int = ITEMS_PER_BLOCK,
    one_each: bool = False,
) -> DataFrame:
    """The ``k`` items with the largest dot product for each customer, exactly.

    ``queries`` is (customer_id, vec), ``items`` is (item_id, vec) and ``seen``
    an optional distinct (customer_id, item_id) table of items to leave out.
    Ties go to the smaller item. Only the best ``k`` per customer and block
    leave the Python workers. The result has a 1-based ``pos``. ``one_each`` says that
    every customer has one row in ``queries``: lists of a small catalogue are then final and not shuffled.

    A catalogue below ``limit_bytes`` (default: the bound of all joins) is broadcast. A larger
    one is staged and read block by block in every task, which holds
    ``customers_per_block`` customers at a time. Customers are not copied either way.
    """
    items = items.select("item_id", "vec")
    queries = queries.select("customer_id", "vec")
    schema = _result_schema(queries, items)
    if fits_broadcast(items, dims * 8, limit_bytes):
        scored = _scored_by_broadcast(queries, items, k, seen, f"{schema}, pos int")
        if one_each:
            return scored
        scored = scored.drop("pos")
    else:
        scored = _scored_by_blocks(
            queries, items, k, seen, schema, customers_per_block, items_per_block
        )
    return top_n(scored, "customer_id", [F.col("score").desc(), F.col("item_id")], k)


def _scored_by_broadcast(
    queries: DataFrame, items: DataFrame, k: int, seen: DataFrame | None, schema: str
) -> DataFrame:
    spark = queries.sparkSession
    table = items.toArrow()  # size checked by the caller
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(_sorted_matrix(table))
    if seen is None:
        rows = queries.withColumn("seen", F.lit(None).cast("array<string>"))
    else:
        # Per customer no longer than the catalogue, which is known to be small here.
        lists = seen.groupBy("customer_id").agg(F.collect_list("item_id").alias("seen"))
        rows = queries.join(lists, "customer_id", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        step = max(1, _CELLS // len(matrix))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                found = _best(_lists_matrix(some.column(1)), some.column(2), names, matrix, k)
                yield _ranked(some.column(0), names, *found)

    return rows.mapInArrow(score, schema)


def _keep_best(
    rows: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int, order_of: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest scores of every row, ties to the smaller place; sorted by row and rank."""
    order = np.lexsort((at if order_of is None else order_of[at], -scores, rows))
    rows, at, scores = rows[order], at[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    kept = place < k
    return rows[kept], at[kept], scores[kept]


class _RunningBest:
    """The best ``k`` items so far of each of some customers, while blocks of items pass by.

    Finds are collected and cut to ``k`` per customer when there are as many as
    the state may hold, so memory stays at customers x k entries.
    """

    def __init__(self, vecs: np.ndarray, seen: list, k: int):
        self.vecs, self.k, self.n = vecs, k, len(vecs)
        self.rows = self.at = np.zeros(0, np.int64)
        self.scores = np.zeros(0)
        self.floor = np.full(self.n, -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_found = 0
        lists = [np.zeros(0, np.int64) if s is None else np.asarray(s, np.int64) for s in seen]
        seen_at = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        order = np.argsort(seen_at, kind="stable")
        self.seen_at = seen_at[order]
        self.seen_row = np.repeat(np.arange(self.n), [len(x) for x in lists])[order]

    def add(self, at: np.ndarray, matrix: np.ndarray) -> None:
        """Score the items at the given places."""
        order = np.argsort(at)
        at, matrix = at[order], matrix[order]
        step = max(1, _CELLS // max(1, self.n))
        for lo in range(0, len(matrix), step):
            places = at[lo : lo + step]
            # Adding 0.0 turns -0.0 into 0.0.
            scores = np.round(self.vecs @ matrix[lo : lo + step].T, SCORE_DIGITS) + 0.0
            near = slice(*np.searchsorted(self.seen_at, [places[0], places[-1] + 1]))
            column = np.searchsorted(places, self.seen_at[near])
            known = places[column] == self.seen_at[near]
            scores[self.seen_row[near][known], column[known]] = -np.inf
            least = self.floor[:, None]
            if len(places) > self.k:
                kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
                least = np.maximum(least, kth)
            r, c = np.nonzero((scores >= least) & np.isfinite(scores))
            self.found.append((r, places[c], scores[r, c]))
            self.n_found += len(r)
            if self.n_found >= self.n * self.k:
                self.cut()

    def cut(self) -> None:
        parts = [(self.rows, self.at, self.scores), *self.found]
        self.rows, self.at, self.scores = _keep_best(*map(np.concatenate, zip(*parts)), self.k)
        self.found, self.n_found = [], 0
        sizes = np.bincount(self.rows, minlength=self.n)
        full = np.flatnonzero(sizes >= self.k)
        self.floor[full] = self.scores[np.cumsum(sizes)[full] - 1]


def _residents(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows of a task in groups of at most ``size``."""
    held, n = [], 0
    for pdf in batches:
        while n + len(pdf) >= size:
            held.append(pdf.iloc[: size - n])
            yield pd.concat(held)
            pdf, held, n = pdf.iloc[size - n :], [], 0
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
    if held:
        yield pd.concat(held)


def _scored_by_blocks(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    seen: DataFrame | None,
    schema: str,
    customers_per_block: int,
    items_per_block: int,
) -> DataFrame:
    """Customers stay in their tasks, and the catalogue passes by in blocks.

    The catalogue is numbered in item order and staged once. Every task holds some
    customers and their best items so far, reads the staged files one block after
    the other, and lets exactly the final list of each customer out. No row is
    copied through a shuffle. A customer's seen items are held as numbers, at most
    one per item of the catalogue.
    """
    numbered = stage(
        dense_index(items, [F.col("item_id")], "at").select("at", "item_id", "vec"), "catalogue"
    )
    files = sorted(numbered.inputFiles())
    if seen is None:
        rows = queries.withColumn("seen", F.lit(None).cast("array<bigint>"))
    else:
        known = lookup(
            seen.select("customer_id", "item_id"), numbered.select("item_id", "at"), "item_id", "inner",
            row_bytes=64, spread="customer_id",
        )
        lists = known.groupBy("customer_id").agg(F.collect_set("at").alias("seen"))
        rows = queries.join(lists, "customer_id", "left")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _residents(batches, customers_per_block):
            best = _RunningBest(np.vstack(pdf["vec"].to_numpy()), pdf["seen"].tolist(), k)
            for block in read_batches(files, ["at", "vec"], items_per_block):
                if block.num_rows:
                    vecs = block.column("vec").flatten().to_numpy(zero_copy_only=False)
                    best.add(block.column("at").to_numpy(), vecs.reshape(block.num_rows, -1))
            best.cut()
            wanted = np.unique(best.at)
            names = np.empty(len(wanted), object)
            for block in read_batches(files, ["at", "item_id"], items_per_block):
                at = block.column("at").to_numpy()
                mine = np.flatnonzero(np.isin(at, wanted, assume_unique=True))
                names[np.searchsorted(wanted, at[mine])] = block.column("item_id").take(mine).to_pylist()
            yield pd.DataFrame(
                {
                    "customer_id": pdf["customer_id"].to_numpy()[best.rows],
                    "item_id": names[np.searchsorted(wanted, best.at)],
                    "score": best.scores,
                }
            )

    return rows.mapInPandas(score, schema)
