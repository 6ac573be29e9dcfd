"""Running numbers and sums per group, also of groups that are too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketrank.functions.staging import stage

# Places of the order column in one segment.
SEGMENT = 262_144


def is_long(df: DataFrame, order: str, width: int | None = None) -> bool:
    """Whether a group of ``df`` may reach beyond one segment; reads the order column alone."""
    return (df.agg(F.max(order)).first()[0] or 0) >= (SEGMENT if width is None else width)


def running(
    df: DataFrame,
    group: str,
    order: str,
    *,
    number: str | None = None,
    sums: dict[str, str | Column] | None = None,
    following: str | None = None,
    split: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Add running values of each group, in the order of a column of whole numbers.

    ``number`` counts the rows from 1, ``sums`` add up columns to the row itself,
    ``following`` is the order value of the next row. ``group`` must not be null.

    One window per group does it while groups are short. With ``split`` a group
    is cut into segments of ``width`` values of the order column, which scatter
    over the tasks: every segment is numbered on its own, the totals of the
    segments are added up per group, and each segment gets what lies before it.
    Only the totals of a group meet in one task. ``df`` is staged then.
    """
    sums = sums or {}
    width = SEGMENT if width is None else width
    if not split:
        return df.withColumns(_local([group], order, number, sums, following))
    rows = stage(df.withColumn("_segment", F.floor(F.col(order) / width)), "segments")
    keys = [group, "_segment"]
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.min(order).alias("_first"),
        *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()],
    )
    segments = Window.partitionBy(group).orderBy("_segment")
    before = segments.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        F.lead("_first").over(segments).alias("_first"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in sums],
    )
    joined = rows.withColumns(_local(keys, order, number, sums, following)).join(offsets, keys)
    whole = {name: F.col(name) + F.col(f"_sum_{name}") for name in sums}
    if number:
        whole[number] = (F.col(number) + F.col("_rows")).cast("int")
    if following:
        whole[following] = F.coalesce(following, "_first")
    helpers = ["_segment", "_rows", "_first", *[f"_sum_{n}" for n in sums]]
    return joined.withColumns(whole).drop(*helpers).select(*df.columns, *whole)


def _local(
    keys: list[str], order: str, number: str | None, sums: dict, following: str | None
) -> dict[str, Column]:
    window = Window.partitionBy(*keys).orderBy(order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {name: F.sum(c).over(so_far) for name, c in sums.items()}
    if number:
        added[number] = F.row_number().over(window)
    if following:
        added[following] = F.lead(order).over(window)
    return added
