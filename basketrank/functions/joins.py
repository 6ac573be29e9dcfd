"""Joins of a long table with one row per key on the other side."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, functions as F, types as T

from basketrank.functions.staging import parts_for, stage

# Upper bound of what a join may broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int | None = None) -> bool:
    """Whether ``df`` has few enough rows.

    Every task counts its own rows, so none of them travel.
    """
    limit = BROADCAST_BYTES if limit_bytes is None else limit_bytes
    return df.count() <= limit // row_bytes


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    *,
    row_bytes: int = 128,
    limit_bytes: int | None = None,
    spread: str | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Join ``fact`` with ``dim``, which holds at most one row per ``key``.

    ``dim`` is broadcast when its rows, taken at ``row_bytes`` each, stay below
    the limit; ``fits`` passes on the answer when it is known already.
    Otherwise both sides are shuffled with the heavy keys split
    (:func:`salted_join`), so one key with a large share of ``fact`` does not
    end in one task. Sides that are costly to compute should be staged.
    """
    if fits is None:
        fits = fits_broadcast(dim, row_bytes, limit_bytes)
    if fits:
        return fact.join(F.broadcast(dim), key, how)
    return salted_join(fact, dim, key, how, spread)


#: A key counts as heavy from this part of one task's share of the rows on.
PARTS_OF_SHARE = 4


def heavy_keys(fact: DataFrame, key: str) -> list[tuple]:
    """(key, ways): keys with a large share of the rows of ``fact``, and how often to split them.

    Taken from a sketch: every task keeps a bounded number of counters, the
    counters are merged, and only ``key`` is read. With P shuffle partitions a key
    is heavy from 1 / (4 P) of the rows on, so there are at most 4 P of them. With
    32 P counters the sketch misses none; it may count a key too high by a ninth
    of a share, which changes how often a key is split, never a result.
    """
    parts = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")) * PARTS_OF_SHARE
    counters = 1 << (8 * parts - 1).bit_length()
    known = fact.select(F.col(key).alias("_key")).filter("_key IS NOT NULL")
    found = known.agg(
        F.expr(f"approx_top_k(_key, {parts}, {counters})").alias("top"), F.count("*").alias("rows")
    ).first()
    return [
        (top["item"], ceil(top["count"] * parts / found["rows"]))
        for top in found["top"] or ()
        if top["count"] * parts > found["rows"]
    ]


def _as_table(fact: DataFrame, key: str, keys: list[tuple]) -> DataFrame:
    """(key, _ways) as a small local table, to be broadcast."""
    kind = fact.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("_ways", T.IntegerType())])
    return F.broadcast(fact.sparkSession.createDataFrame(keys, schema))


def salted_join(
    fact: DataFrame, dim: DataFrame, key: str, how: str = "left", spread: str | None = None
) -> DataFrame:
    """Shuffle join that splits every heavy key of ``fact``.

    A key with s quarter shares of the rows is split s ways: its ``fact`` rows
    scatter by a hash, its single ``dim`` row is repeated s times, 8P rows at the
    very most. Null keys match nothing and are scattered over all partitions.
    ``fact`` is read twice, the first time for its key column alone
    (:func:`heavy_keys`); nothing of it is written. Stage it when it is costly.
    """
    keys = heavy_keys(fact, key)
    parts = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scatter = F.xxhash64(spread) if spread else F.xxhash64(*fact.columns)
    slots = F.when(F.col(key).isNull(), F.lit(parts))
    if not keys:
        left = fact.withColumn("_salt", F.pmod(scatter, slots.otherwise(F.lit(1))).cast("int"))
        right = dim.withColumn("_salt", F.lit(0))
        return left.join(right, [key, "_salt"], how).drop("_salt")
    heavy = _as_table(fact, key, keys)
    ways = F.coalesce(F.col("_ways"), F.lit(1))
    left = (
        fact.join(heavy, key, "left")
        .withColumn("_salt", F.pmod(scatter, slots.otherwise(ways)).cast("int"))
        .drop("_ways")
    )
    right = (
        dim.join(heavy, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1)))
        .drop("_ways")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def add_by_pair(left: DataFrame, right: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Left join on (customer_id, item_id), which must be unique on both sides.

    Done as one grouping of the united rows. A ``left`` that is partitioned by
    customer, as all candidate tables are, stays where it is and keeps that
    partitioning for the steps that follow; a join on both columns would move
    it. ``right`` should be the smaller side.

    ``right`` moves to the customers, and a customer may have any number of rows
    there, while ``left`` holds a bounded list of each. So the pairs of heavy
    customers are cut to those in ``left`` first, where they lie. ``source`` is a
    table cheaper to read in which the same customers are heavy; ``right`` is dealt to as
    many parts as its files ask for, which are those of candidates found in the same table.
    """
    keys = ["customer_id", "item_id"]
    source = right if source is None else source
    right = _without_surplus(left, right, source)
    rows = left.withColumn("_left", F.lit(1)).unionByName(
        right.repartition(parts_for(source), "customer_id").withColumn("_left", F.lit(0)), allowMissingColumns=True
    )
    values = [c for c in rows.columns if c not in (*keys, "_left")]
    return (
        rows.groupBy(*keys)
        .agg(F.max("_left").alias("_left"), *[F.max(c).alias(c) for c in values])
        .filter("_left = 1")
        .drop("_left")
    )


def _without_surplus(left: DataFrame, right: DataFrame, source: DataFrame) -> DataFrame:
    """``right`` without those rows of heavy customers that ``left`` does not ask for."""
    found = heavy_keys(source, "customer_id")
    if not found:
        return right
    keys = ["customer_id", "item_id"]
    heavy = _as_table(source, "customer_id", found)
    asked = stage(
        left.join(heavy, "customer_id", "left_semi").select(*keys).withColumn("_asked", F.lit(True)),
        "asked-pairs",
    )
    marked = right.join(heavy, "customer_id", "left")
    if fits_broadcast(asked, 64):
        kept = marked.join(F.broadcast(asked), keys, "left")
    else:
        # By both columns, which spreads a customer over the items.
        kept = marked.join(asked, keys, "left")
    return kept.filter("_ways IS NULL OR _asked").select(*right.columns)
