"""Exact duplicates by a heavy-hitter split, with DataFrame functions only.

1. Every text becomes a SHA-256 digest; (id, digest) is staged, so texts are
   read once for the decisions.
2. A Misra-Gries summary (Spark's ``approx_top_k``, a mergeable frequent-items
   sketch of fixed size per task) names digests that may be frequent.
3. Their exact counts and winners are verified by one aggregation that combines
   in the map tasks. Digests with more than one ``capacity``-th of all rows are
   heavy; there are fewer than ``capacity`` of them, which bounds the broadcast.
4. Rows of heavy digests are decided where they lie. All other rows are
   shuffled by digest; no group among them exceeds 1/``capacity`` of the rows.

Defined results: a null text counts as empty; a null id ranks below all ids; of
rows that repeat both id and text exactly one stays; an empty table gives an
empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketrank.functions.staging import stage
from basketrank.llm.common import fresh, named

#: Digests that hold more than 1/CAPACITY of the rows are removed map-side.
CAPACITY = 4096
#: Counters of the summary; above CAPACITY so that its error stays below the bound.
COUNTERS = 4 * CAPACITY


def _digest(text: str):
    return F.sha2(F.coalesce(named(text).cast("string"), F.lit("")).cast("binary"), 256)


def heavy_digests(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(digest, _best, _copies) of the digests with more than 1/capacity of ``rows``.

    ``rows`` has (digest, _best), ``_best`` an orderable value; the result holds
    its maximum. Fewer than ``capacity`` rows.
    """
    total = rows.count()
    counters = max(COUNTERS, 4 * capacity)
    suspects = rows.agg(
        F.expr(f"approx_top_k(xxhash64(digest), {counters // 2}, {counters})").alias("top")
    ).select(F.explode("top.item").alias("_suspect"))
    return stage(
        rows.withColumn("_suspect", F.xxhash64("digest"))
        .join(F.broadcast(suspects), "_suspect", "left_semi")
        .groupBy("digest")
        .agg(F.max("_best").alias("_best"), F.count(F.lit(1)).alias("_copies"))
        .filter(F.col("_copies") * capacity > total),
        "heavy-digests",
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of equal texts the row with the largest id stays.
    """
    rows = stage(
        docs.select(
            named(id_col).alias("_id"),
            F.unhex(_digest(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "digests",
    ).select("digest", F.struct("_id", "_row").alias("_best"))
    heavy = heavy_digests(rows, capacity)
    split = rows.withColumnRenamed("_best", "_own").join(F.broadcast(heavy), "digest", "left")
    same = Window.partitionBy("digest")
    light = (
        split.filter("_copies IS NULL")
        .withColumn("_best", F.max("_own").over(same))
        .withColumn("_copies", F.count(F.lit(1)).over(same))
    )
    return (
        split.filter("_copies IS NOT NULL")
        .unionByName(light)
        .select(
            F.col("_own._id").alias(id_col),
            F.col("_best._id").alias("keep_id"),
            F.col("_copies").alias("group_size"),
            (F.col("_own._row") == F.col("_best._row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """``docs`` without all but the last (largest id) of equal texts, all columns kept.

    Copies of heavy texts go before the shuffle; the texts that are left are
    moved once, by digest.
    """
    digest, best, place = fresh(docs, "digest", "_best", "_place")
    heavy = heavy_digests(
        docs.select(_digest(text_col).alias("digest"), named(id_col).alias("_best")), capacity
    ).select(F.col("digest").alias(digest), F.col("_best").alias(best))
    last = Window.partitionBy(digest).orderBy(named(id_col).desc_nulls_last())
    return (
        docs.withColumn(digest, _digest(text_col))
        .join(F.broadcast(heavy), digest, "left")
        .filter(named(best).isNull() | (named(best) == named(id_col)))
        .withColumn(place, F.row_number().over(last))
        .filter(named(place) == 1)
        .select(*[named(c) for c in docs.columns])
    )
