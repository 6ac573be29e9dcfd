"""The three input tables, from Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from basketrank.schema import EVENTS, ITEMS, TRANSACTIONS, conform

# Partition columns of tables written by write_by_month.
MONTH_FOLDERS = ("part_year", "part_month")


@dataclass(frozen=True)
class Tables:
    """Input tables in their logical shape; ``events`` may be absent."""

    transactions: DataFrame
    items: DataFrame
    events: DataFrame | None = None


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan ``path`` in the shape of ``schema``.

    The folder columns of a table written by month are kept, and the split
    operators filter on them.
    """
    raw = spark.read.parquet(path)
    return conform(raw, schema, tuple(c for c in MONTH_FOLDERS if c in raw.columns))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TRANSACTIONS)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, EVENTS)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ITEMS)


def open_tables(
    spark: SparkSession, transactions: str, items: str, events: str | None = None
) -> Tables:
    return Tables(
        read_transactions(spark, transactions),
        read_items(spark, items),
        read_events(spark, events) if events else None,
    )


def write_by_month(df: DataFrame, path: str, ts: str, *more_keys: str) -> None:
    """Write a table into one folder per year and month of ``ts``.

    Rows are range-partitioned first: each task writes to few folders, a busy
    month is cut into several files, and ``more_keys`` split a heavy customer.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    year, month = MONTH_FOLDERS
    (
        df.withColumns({year: F.year(ts), month: F.month(ts)})
        .repartitionByRange(parts, year, month, "customer_id", ts, *more_keys)
        .write.partitionBy(year, month)
        .parquet(path)
    )
