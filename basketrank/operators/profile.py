"""Table profiles and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketrank.functions.expressions import n_distinct
from basketrank.sources.tables import MONTH_FOLDERS

# Counters of a distinct-count sketch, as a power of two.
SKETCH_PRECISION = 12


def table_profile(
    df: DataFrame, ts: str | None = None, distinct: dict[str, str] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """One row: number of rows, first and last ``ts``, distinct values per column.

    ``distinct`` maps columns to output names. ``approximate`` replaces the exact
    counts, which shuffle one row per value, by sketches.
    """
    out = [F.count("*").alias("n_rows")]
    if ts:
        out += [F.min(ts).alias("date_min"), F.max(ts).alias("date_max")]
    for column, name in (distinct or {}).items():
        count = F.approx_count_distinct(column) if approximate else n_distinct(column)
        out.append(count.alias(name))
    return df.agg(*out)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def monthly_distribution(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.month(ts).alias("month")).agg(F.count("*").alias("n")).orderBy("month")


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``, all columns unless named: the same rows every time."""
    return df.orderBy(*(order or df.columns)).limit(n)


def monthly_sketches(df: DataFrame, ts: str, columns: list[str], precision: int = SKETCH_PRECISION) -> DataFrame:
    """(part_year, part_month, n_rows, date_min, date_max, sketch of each column), one row per month.

    To be stored beside a table's month folders. A sketch takes 2^precision bytes
    at most and can be merged with those of other months.
    """
    year, month = MONTH_FOLDERS
    return df.groupBy(F.year(ts).alias(year), F.month(ts).alias(month)).agg(
        F.count("*").alias("n_rows"),
        F.min(ts).alias("date_min"),
        F.max(ts).alias("date_max"),
        *[F.hll_sketch_agg(c, precision).alias(f"sketch_{c}") for c in columns],
    )


def profile_of_sketches(sketches: DataFrame, distinct: dict[str, str]) -> DataFrame:
    """:func:`table_profile` of all months in ``sketches``, without reading their rows.

    Rows and dates are exact. Distinct counts are estimates: with 2^p counters the
    standard error is 1.04 / sqrt(2^p), 1.6 percent by default.
    """
    return sketches.agg(
        F.sum("n_rows").alias("n_rows"),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
        *[
            F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{column}")).alias(name)
            for column, name in distinct.items()
        ],
    )
