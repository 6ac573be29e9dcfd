"""Candidate source 2: items bought together on one bill."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketrank.config import CandidateLimits
from basketrank.functions.expressions import n_distinct
from basketrank.functions.joins import BROADCAST_BYTES, fits_broadcast, lookup
from basketrank.functions.ordering import dense_index_sized, top_n
from basketrank.functions.staging import parts_for, stage


# Items of one bill that are paired in one row when bills have no limit.
BILL_BLOCK = 128
# Chunks of bills for every task that counts pairs.
CHUNKS = 4


def bill_items(
    transactions: DataFrame, max_items: int | None = CandidateLimits.items_per_bill
) -> DataFrame:
    """Distinct (bill_id, item_id), the first ``max_items`` items of each bill by name.

    The limit is part of the definition: it bounds the pairs of one bill, and
    items late in the alphabet lose pairs. None takes whole bills.
    """
    # Dealt to as many tasks as the input asks for: none of them holds more when it grows.
    dealt = transactions.select("bill_id", "item_id").repartition(parts_for(transactions), "bill_id", "item_id")
    pairs = dealt.distinct()
    return pairs if max_items is None else top_n(pairs, "bill_id", [F.col("item_id")], max_items)


def bill_stats(bills: DataFrame) -> DataFrame:
    return bills.agg(
        n_distinct("bill_id").alias("n_bills"),
        n_distinct("item_id").alias("n_items"),
        F.count("*").alias("n_pairs"),
    )


def _counted(pairs: DataFrame, parts: int) -> DataFrame:
    """(a, b, n) from (chunk, a, b) that lies by chunk: counted in place, then summed over the chunks."""
    counted = pairs.groupBy("chunk", "a", "b").agg(F.count("*").alias("n"))
    return counted.repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_counts(bills: DataFrame, limited: bool = True, block: int = BILL_BLOCK) -> DataFrame:
    """(a, b, n) with a < b: the number of bills that hold both items.

    A ``limited`` bill's items fit into one short array, on which pairs are
    formed without a join; the array needs the same partitioning as the limit in
    ``bill_items``. Bills without a limit are cut into blocks of about ``block``
    items, and every two blocks of a bill meet in a row of their own, so a long
    bill spreads over many tasks.
    """
    bills = bills.filter("bill_id IS NOT NULL AND item_id IS NOT NULL")
    parts = parts_for(bills)
    if not limited:
        return _counted(_pairs_by_blocks(bills, block, parts), parts)
    arrays = (
        bills.withColumn("chunk", F.pmod(F.xxhash64("bill_id"), F.lit(parts * CHUNKS)))
        .repartition(parts, "chunk")
        .groupBy("chunk", "bill_id")
        .agg(F.array_sort(F.collect_list("item_id")).alias("items"))
        .filter(F.size("items") > 1)
    )
    firsts = arrays.select("chunk", F.posexplode("items").alias("at", "a"), "items")
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    return _counted(firsts.select("chunk", "a", F.explode(rest).alias("b")), parts)


def _pairs_by_blocks(bills: DataFrame, block: int, parts: int) -> DataFrame:
    """(chunk, a, b) with a < b, once for every bill that holds both."""
    ways = bills.groupBy("bill_id").agg(F.ceil(F.count("*") / block).cast("int").alias("ways"))
    placed = bills.join(ways, "bill_id").withColumn("own", F.pmod(F.xxhash64("item_id"), "ways").cast("int"))
    blocks = placed.groupBy("bill_id", "ways", "own").agg(F.collect_list("item_id").alias("items"))
    other = F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("other")
    i, j = F.least("own", "other"), F.greatest("own", "other")
    chunk = F.pmod(F.xxhash64("bill_id", "i", "j"), F.lit(parts * CHUNKS))
    meeting = (
        blocks.select("bill_id", "own", "items", other)
        .select("bill_id", "items", i.alias("i"), j.alias("j"))
        .withColumn("chunk", chunk)
        .repartition(parts, "chunk")
        .groupBy("chunk", "bill_id", "i", "j")
        .agg(F.collect_list("items").alias("lists"))
    )
    first, second = F.col("lists")[0], F.get(F.col("lists"), F.lit(1))
    pairs = meeting.filter("i = j OR size(lists) = 2").select(
        "chunk", F.explode(first).alias("x"), F.when(F.col("i") == F.col("j"), first).otherwise(second).alias("others"),
        (F.col("i") == F.col("j")).alias("same"),
    ).select("chunk", "x", F.explode("others").alias("y"), "same")
    # Inside one block every pair appears in both directions.
    return pairs.filter("x < y OR (x > y AND NOT same)").select(
        "chunk", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    )


def covisit_neighbours(
    transactions: DataFrame,
    per_item: int | None = CandidateLimits.neighbours_per_item,
    max_bill: int | None = CandidateLimits.items_per_bill,
) -> DataFrame:
    """(item_id, co_item_id, score, rn): the items most often on the same bills.

    None lifts either limit: whole bills are paired, every partner of an item is kept.
    Each unordered pair is counted once and turned into both directions after
    the count, which halves the shuffle.
    """
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("item_id"), F.col("b").alias("co_item_id")),
            F.struct(F.col("b").alias("item_id"), F.col("a").alias("co_item_id")),
        )
    )
    directed = (
        pair_counts(bill_items(transactions, max_bill), max_bill is not None)
        .select(both.alias("p"), F.col("n").alias("score"))
        .select("p.item_id", "p.co_item_id", "score")
    )
    return top_n(
        directed.repartition(parts_for(transactions), "item_id"),
        "item_id", [F.col("score").desc(), F.col("co_item_id")], per_item, pos="rn",
    )


@dataclass(frozen=True)
class NeighbourIndex:
    """Neighbour lists by integer codes, made once and used by any number of customers.

    ``codes`` is (item_id, code) in item order, ``lists`` (item_id, own, near) with
    the item's own code and its neighbours as (code, score). Both are stored.
    """

    codes: DataFrame
    lists: DataFrame
    few_codes: bool
    few_lists: bool

    @classmethod
    def of(cls, neighbours: DataFrame, limit_bytes: int | None = None) -> NeighbourIndex:
        """``neighbours`` is read several times: stage it."""
        limit = BROADCAST_BYTES if limit_bytes is None else limit_bytes
        named = neighbours.select("item_id").union(neighbours.select("co_item_id")).distinct()
        codes, n_codes = dense_index_sized(named, [F.col("item_id")], "code")
        codes = stage(codes.withColumn("code", F.col("code").cast("int")), "codes")
        few_codes = n_codes * 128 <= limit
        near = lookup(
            neighbours.select("item_id", "co_item_id", "score"),
            codes.withColumnRenamed("item_id", "co_item_id"),
            "co_item_id", "inner", fits=few_codes, spread="item_id",
        )
        # One short list per item, so the history meets a table with unique keys.
        lists = (
            near.groupBy("item_id")
            .agg(F.collect_list(F.struct("code", "score")).alias("near"))
            .join(codes.withColumnRenamed("code", "own"), "item_id")
        )
        few_lists = fits_broadcast(neighbours, 32, limit_bytes)
        return cls(codes, stage(lists.select("item_id", "own", "near"), "neighbour-lists"), few_codes, few_lists)

    def save(self, path: str) -> None:
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        self.lists.write.mode("overwrite").parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark: SparkSession, path: str, limit_bytes: int | None = None) -> NeighbourIndex:
        limit = BROADCAST_BYTES if limit_bytes is None else limit_bytes
        codes, lists = (spark.read.parquet(f"{path}/{name}") for name in ("codes", "lists"))
        pairs = lists.agg(F.coalesce(F.sum(F.size("near")), F.lit(0))).first()[0]
        return cls(codes, lists, codes.count() * 128 <= limit, pairs * 32 <= limit)


def covisit_candidates(
    history: DataFrame, neighbours: DataFrame | NeighbourIndex, n: int = CandidateLimits.covisit,
    limit_bytes: int | None = None, parts: int | None = None,
) -> DataFrame:
    """(customer_id, item_id, score, pos): neighbours of the history, scores added up.

    Items of the history itself are left out. The neighbour lists come to the history,
    packed into two short arrays of codes and scores, and only these move to the
    customers; a task then adds up one batch of customers after the other, so neither
    its memory nor the shuffle holds a row per customer and neighbour.
    ``neighbours`` may be a table, which is indexed on the spot, or its index. ``history`` is
    read twice: stage it, and give the ``parts`` that the table it comes from asks for.
    """
    index = neighbours if isinstance(neighbours, NeighbourIndex) else NeighbourIndex.of(neighbours, limit_bytes)
    spark = history.sparkSession
    # Narrow scores, where they fit, halve what moves.
    top = index.lists.agg(F.max(F.array_max("near.score"))).first()[0] or 0
    kind = next((k for k, bits in (("smallint", 15), ("int", 31)) if top < 1 << bits), "bigint")
    lists = index.lists.select(
        "item_id", "own", F.col("near.code").alias("codes"), F.col("near.score").cast(f"array<{kind}>").alias("scores")
    )
    # Items without neighbours are nobody's neighbour either.
    asked = history.select("customer_id", "item_id")
    if index.few_lists:
        found = lookup(asked, lists.select("item_id", "own"), "item_id", "inner", fits=True)
        held = spark.sparkContext.broadcast(_Lists.of(lists))
    else:
        found = lookup(asked, lists, "item_id", "inner", spread="customer_id", fits=False)
        held = None
    rows = found.drop("item_id").repartition(parts or parts_for(history), "customer_id").sortWithinPartitions("customer_id")
    customer = history.schema["customer_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                done, kept = _add_up(batch.slice(lo, _ROWS), held.value if held else None, kept, n)
                if done is not None:
                    yield done
        if kept is not None:
            yield _best_codes(pa.array([kept[0]], kept[1]), *kept[2:], n)

    best = rows.mapInArrow(run, f"customer_id {customer}, code int, score long, pos int")
    return lookup(best, index.codes, "code", "inner", fits=index.few_codes, spread="customer_id").select(
        "customer_id", "item_id", "score", "pos"
    )


# Rows of the history that are added up at a time.
_ROWS = 4096


@dataclass
class _Lists:
    """Neighbour lists by own code, as flat arrays; list i has its entries from ``starts[i]`` on."""

    starts: np.ndarray
    codes: np.ndarray
    scores: np.ndarray

    @classmethod
    def of(cls, lists: DataFrame) -> _Lists:
        table = lists.select("own", "codes", "scores").toArrow()  # size checked by the caller
        own = table.column("own").to_numpy().astype(np.int64)
        order = np.argsort(own)
        sorted_lists = table.take(pa.array(order))
        sizes = np.zeros(int(own.max(initial=-1)) + 1, np.int64)
        codes, scores = (pa.concat_arrays([pa.array([], c.type), *c.chunks]) for c in sorted_lists.columns[1:])
        sizes[own[order]] = np.diff(_offsets(codes))
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (codes, scores)]
        return cls(np.concatenate([[0], np.cumsum(sizes)]), *flat)

    def take(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, score) of the lists of all rows."""
        sizes = self.starts[own + 1] - self.starts[own]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[own] - (np.cumsum(sizes) - sizes), sizes)
        return np.repeat(np.arange(len(own)), sizes), self.codes[at], self.scores[at]


def _offsets(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy()


def _summed(row: np.ndarray, code: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores added up by (row, code), in that order."""
    key = row.astype(np.int64) << 32 | code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(score[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, sums


def _add_up(batch: pa.RecordBatch, held: _Lists | None, kept: tuple | None, n: int) -> tuple:
    """(best codes of the customers that end in the batch, what is known of its last customer).

    Rows come sorted by customer. Of the last one the sums and own items are kept, which
    are never more than the catalogue has items.
    """
    customers = batch.column(0)
    named = customers.dictionary_encode(null_encoding="encode").indices.to_numpy()
    turns = np.concatenate([[0], np.flatnonzero(np.diff(named)) + 1])
    row_of = np.zeros(len(named), np.int64)
    row_of[turns[1:]] = 1
    row_of = np.cumsum(row_of)
    own = batch.column(1).to_numpy().astype(np.int64)
    if held is not None:
        at, code, score = held.take(own)
    else:
        codes = batch.column(2)
        at = np.repeat(np.arange(len(own)), np.diff(_offsets(codes)))
        code, score = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
    row, code, score, own_row = row_of[at], code, score, row_of
    firsts = customers.take(pa.array(turns))
    out = []
    if kept is not None:
        if firsts[0].as_py() == kept[0]:
            row = np.concatenate([np.zeros(len(kept[3]), np.int64), row])
            code, score = np.concatenate([kept[3], code]), np.concatenate([kept[4], score])
            own, own_row = np.concatenate([kept[6], own]), np.concatenate([np.zeros(len(kept[6]), np.int64), own_row])
        else:
            out.append(_best_codes(pa.array([kept[0]], kept[1]), *kept[2:], n))
    row, code, score = _summed(row, code, score)
    last = len(turns) - 1
    cut, own_cut = np.searchsorted(row, last), np.searchsorted(own_row, last)
    if last:
        out.append(
            _best_codes(firsts.slice(0, last), row[:cut], code[:cut], score[:cut], own_row[:own_cut], own[:own_cut], n)
        )
    zeros = np.zeros(len(row) - cut, np.int64)
    mine = np.unique(own[own_cut:])
    kept = (firsts[last].as_py(), firsts.type, zeros, code[cut:], score[cut:], np.zeros(len(mine), np.int64), mine)
    done = pa.Table.from_batches(out).combine_chunks().to_batches() if out else []
    return (done[0] if done else None), kept


def _best_codes(customers: pa.Array, row, code, score, own_row, own, n: int) -> pa.RecordBatch:
    """The ``n`` codes with the largest sums of each row, own items left out; sums come by (row, code)."""
    key, mine = row << 32 | code, np.unique(own_row << 32 | own)
    if len(mine):
        at = np.minimum(np.searchsorted(mine, key), len(mine) - 1)
        free = mine[at] != key
        row, code, score = row[free], code[free], score[free]
    order = np.lexsort((-score, row))
    row, code, score = row[order], code[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    best = place < n
    return pa.RecordBatch.from_arrays(
        [
            customers.take(pa.array(row[best])),
            pa.array(code[best].astype(np.int32)),
            pa.array(score[best]),
            pa.array((place[best] + 1).astype(np.int32)),
        ],
        ["customer_id", "code", "score", "pos"],
    )
