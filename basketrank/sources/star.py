"""Purchase lines, items and events from a sales star schema.

Maps ``lineitem``, ``orders``, ``part``, ``events`` and ``embeddings`` Parquet
files onto the logical tables. ``by="group"`` makes brand and type one item,
``by="part"`` takes every part as an item of its own.

The joins carry no hints: orders and parts are scans, so Spark compares their
file sizes with spark.sql.autoBroadcastJoinThreshold, and beyond it adaptive
execution splits skewed join partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from basketrank.functions.joins import lookup
from basketrank.functions.vectors import weighted_mean
from basketrank.sources.tables import Tables

GROUP = "group"
PART = "part"


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _item_id(by: str) -> Column:
    if by == PART:
        return F.col("p_partkey").cast("string")
    return F.concat_ws("|", "p_brand", "p_type")


def transactions(spark: SparkSession, folder: str, by: str = GROUP) -> DataFrame:
    lines = scan(spark, folder, "lineitem")
    orders = scan(spark, folder, "orders")
    parts = scan(spark, folder, "part")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_custkey").cast("int").alias("customer_id"),
            _item_id(by).alias("item_id"),
            F.col("l_orderkey").alias("bill_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
            F.col("l_discount").cast("decimal(4,2)").alias("discount"),
            F.col("o_orderdate").alias("updated_date"),
        )
    )


def items(spark: SparkSession, folder: str, by: str = GROUP) -> DataFrame:
    parts = scan(spark, folder, "part")
    if by == PART:
        l2 = F.when(
            F.col("p_size") % 13 != 0, F.concat_ws("/", "p_type", F.col("p_size") % 5)
        )
        return parts.select(
            _item_id(by).alias("item_id"),
            F.when(F.col("p_size") % 10 == 0, 0).otherwise(1).alias("sale_status"),
            F.col("p_type").alias("category_l1"),
            l2.alias("category_l2"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        )
    number = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int")
    return parts.groupBy("p_brand", "p_type").agg(
        F.min("p_retailprice").cast("decimal(12,2)").alias("price")
    ).select(
        _item_id(by).alias("item_id"),
        F.when(number % 10 == 0, 0).otherwise(1).alias("sale_status"),
        F.col("p_type").alias("category_l1"),
        F.concat_ws("/", "p_type", number % 5).alias("category_l2"),
        F.col("p_brand").alias("brand"),
        "price",
    )


def _item_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted position of each grouped item.

    Brands and types are two short fixed lists, so this is a table of a few
    hundred rows at any scale factor and one ordered window is enough.
    """
    groups = scan(spark, folder, "part").select(_item_id(GROUP).alias("item_id")).distinct()
    return groups.withColumn("slot", F.row_number().over(Window.orderBy("item_id")) - 1)


def events(spark: SparkSession, folder: str) -> DataFrame:
    slots = _item_slots(spark, folder)
    raw = scan(spark, folder, "events").withColumn(
        "slot", F.get_json_object("props", "$.k").cast("int")
    )
    return lookup(raw, slots, "slot", "inner", row_bytes=64, spread="user_id").select(
        F.col("user_id").cast("int").alias("customer_id"),
        "item_id",
        "event_type",
        F.col("ts").alias("event_date"),
    )


def embedding_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )


def item_vectors(spark: SparkSession, folder: str, by: str = GROUP) -> DataFrame:
    """(item_id, vec): every embedding row and every item takes part.

    With n items and m rows numbered from 0, a part has row ``p_partkey`` mod m and
    the grouped item at position i the mean of the rows whose number is i mod n.
    """
    rows = embedding_rows(spark, folder)
    if by == PART:
        place = (F.col("p_partkey") % rows.count()).alias("vec_id")
        parts = scan(spark, folder, "part").select(_item_id(PART).alias("item_id"), place)
        return parts.join(rows, "vec_id").select("item_id", "vec")
    slots = _item_slots(spark, folder)
    placed = rows.select((F.col("vec_id") % slots.count()).alias("slot"), "vec", F.lit(1.0).alias("one"))
    return slots.join(weighted_mean(placed, "slot", "one"), "slot").select("item_id", "vec")


def open_star(spark: SparkSession, folder: str, by: str = GROUP) -> Tables:
    return Tables(
        transactions(spark, folder, by),
        items(spark, folder, by),
        events(spark, folder) if by == GROUP else None,
    )
