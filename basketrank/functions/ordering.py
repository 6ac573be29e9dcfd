"""Ranks, indexes and seeded samples that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketrank.functions.staging import stage


def top_n(
    df: DataFrame, group: str, order: list[Column], n: int | None, pos: str = "pos"
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, numbered from 1; None keeps all.

    Spark cuts every map partition to ``n`` rows per group before the shuffle
    (WindowGroupLimit), so a large group does not travel whole.
    """
    window = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn(pos, F.row_number().over(window))
    return ranked if n is None else ranked.filter(F.col(pos) <= n)


def renumber(df: DataFrame, group: str, pos: str = "pos") -> DataFrame:
    """Close the gaps that a filter left in the positions of each group."""
    window = Window.partitionBy(group).orderBy(pos)
    return df.withColumn(pos, F.row_number().over(window))


def dense_index(
    df: DataFrame, order: list[Column], name: str = "idx", start: int = 0
) -> DataFrame:
    """Number all rows in ``order`` without bringing them into one task.

    Rows are range-partitioned and sorted, every partition numbers its own rows,
    and the numbered table is staged so that all reads see the same partitions.
    The driver adds up one count per partition; the index is then a projection.
    """
    return dense_index_sized(df, order, name, start)[0]


def dense_index_sized(
    df: DataFrame, order: list[Column], name: str = "idx", start: int = 0
) -> tuple[DataFrame, int]:
    """:func:`dense_index` together with the number of rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = stage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id()),
        name,
    )
    # The upper bits of the generated id are the partition, the lower 33 the row in it.
    numbered = numbered.withColumns(
        {"_part": F.shiftright("_row", 33).cast("int"), "_row": F.col("_row").bitwiseAND((1 << 33) - 1)}
    )
    sizes = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}
    offsets, total = [], 0
    for part in range(parts):
        offsets.append(total)
        total += sizes.get(part, 0)
    # One constant array in the plan, folded from its text.
    table = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    indexed = numbered.withColumn(
        name, F.get(table, F.col("_part")) + F.col("_row") + F.lit(start)
    ).drop("_part", "_row")
    return indexed, total


def seeded_hash(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


# Hex digits that choose a bucket of the seeded hash: 65,536 buckets.
_BUCKET_DIGITS = 4


def hash_take(df: DataFrame, keys: list[str], n: int | Column, seed: int = 42) -> DataFrame:
    """Exactly the ``n`` rows with the smallest seeded hash of their unique ``keys``.

    A repeatable sample without replacement: all rows up to the n-th smallest hash.
    That hash is found before, from the keys alone: rows are counted per hash
    bucket, and only the bucket it lies in is sorted, about 1/65,536 of the rows.
    The sample itself is one filter on one scan, and nothing of it is shuffled.
    ``df`` is read three times, twice for its keys: stage it when it is costly.
    """
    hashed = df.withColumn("_hash", seeded_hash(keys, seed))
    bucket = F.substring("_hash", 1, _BUCKET_DIGITS)
    # 65,536 rows at most.
    counts = hashed.groupBy(bucket.alias("bucket")).count()
    if not isinstance(n, int):
        n = df.sparkSession.range(1).select(n).first()[0] or 0
    left, edge = n, None
    for row in sorted(counts.collect()):
        if row["count"] > left:
            edge = row["bucket"]
            break
        left -= row["count"]
    if edge is None:
        return df
    if left <= 0:
        # Everything before the bucket, nothing in it.
        cut = edge
        return hashed.filter(F.col("_hash") < cut).drop("_hash")
    inside = hashed.filter(bucket == edge).select("_hash").orderBy("_hash").limit(left)
    cut = inside.agg(F.max("_hash")).first()[0]
    return hashed.filter(F.col("_hash") <= cut).drop("_hash")
