"""Column expressions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour days between two timestamps; midnights are not counted."""
    return F.date_part(F.lit("DAY"), later - earlier).cast("int")


def latest(df: DataFrame, ts: str) -> Column:
    """The last timestamp of a table, read once and usable in any plan as a constant."""
    last = df.agg(F.max(ts).cast("string")).first()[0]
    return F.lit(last).cast(df.schema[ts].dataType)


def n_distinct(name: str) -> Column:
    """Distinct values, where null counts as one value."""
    return F.count_distinct(F.col(name)) + has_null(name)


def distinct_counts(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, names...): distinct non-null values of several columns per key.

    Kept apart from other aggregates: Spark shuffles one row per distinct
    (key, value) here, and in one aggregation with sums and counts each of these
    rows would carry all of their buffers.
    """
    return df.groupBy(key).agg(*[F.count_distinct(c).alias(n) for c, n in columns.items()])


def has_null(name: str) -> Column:
    """1 when a group has a null in the column, which counts as one more value."""
    return F.max(F.col(name).isNull().cast("int"))


def mean(name: str) -> Column:
    """Mean of the non-null values, from an exact sum where the type is exact."""
    return F.try_divide(F.sum(name).cast("double"), F.count(name))


def event_weight(weights: dict[str, float], event_type: str = "event_type") -> Column:
    """Weight of an event type; types not listed weigh 0."""
    pairs = [F.lit(x) for kind, w in weights.items() for x in (kind, w)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(event_type)), F.lit(0.0))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
