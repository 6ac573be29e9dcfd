"""Train, validation and test parts by calendar month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketrank import config
from basketrank.functions.expressions import any_of, n_distinct
from basketrank.functions.joins import fits_broadcast, lookup
from basketrank.sources.tables import MONTH_FOLDERS

TRAIN, VAL, TEST = "train", "val", "test"


@dataclass(frozen=True)
class SplitRule:
    """Months of each part; with ``year`` set, other years belong to none.

    Without a year the months of all years fall together, so on data of several
    years some training rows are later than validation rows.
    """

    train: tuple[int, int] = config.TRAIN_MONTHS
    val: int = config.VAL_MONTH
    test: int = config.TEST_MONTH
    year: int | None = None

    def months(self, part: str) -> tuple[int, int]:
        return {TRAIN: self.train, VAL: (self.val, self.val), TEST: (self.test, self.test)}[part]


# History and target parts of each prediction target; "jan2026" has no target
# month in the data and takes the customers of the last one.
HISTORY_OF = {VAL: (TRAIN,), TEST: (TRAIN, VAL), "jan2026": (TRAIN, VAL, TEST)}
TARGET_OF = {VAL: VAL, TEST: TEST, "jan2026": TEST}


def _first_of(year: int, month: int) -> Column:
    if month > 12:
        year, month = year + 1, month - 12
    return F.lit(f"{year:04d}-{month:02d}-01 00:00:00").cast("timestamp_ntz")


def in_part(df: DataFrame, ts: str, part: str, rule: SplitRule) -> Column:
    """Predicate of one part.

    With a year it is a plain range on ``ts``, which reaches the Parquet scan.
    Tables written by month are also filtered on their folders.
    """
    first, last = rule.months(part)
    if rule.year is not None:
        test = (F.col(ts) >= _first_of(rule.year, first)) & (
            F.col(ts) < _first_of(rule.year, last + 1)
        )
    else:
        test = F.month(ts).between(first, last)
    year, month = MONTH_FOLDERS
    if month in df.columns:
        test = F.col(month).between(first, last) & test
        if rule.year is not None:
            test = (F.col(year) == rule.year) & test
    return test


def take(
    df: DataFrame, ts: str, parts: tuple[str, ...] = (TRAIN,), rule: SplitRule = SplitRule()
) -> DataFrame:
    """Rows of the named parts."""
    return df.filter(any_of([in_part(df, ts, p, rule) for p in parts]))


def with_part(df: DataFrame, ts: str, rule: SplitRule = SplitRule()) -> DataFrame:
    """All rows that belong to a part, labelled in a ``split`` column, in one pass."""
    parts = (TRAIN, VAL, TEST)
    label = F.lit(None).cast("string")
    for part in reversed(parts):
        label = F.when(in_part(df, ts, part, rule), part).otherwise(label)
    # The filter names the dates themselves, so that it reaches the scan.
    return take(df, ts, parts, rule).withColumn("split", label)


def split_stats(df: DataFrame, ts: str, rule: SplitRule = SplitRule()) -> DataFrame:
    """Rows, share of rows, customers and items of each part."""
    parts = (
        with_part(df, ts, rule)
        .groupBy("split")
        .agg(
            F.count("*").alias("n_rows"),
            n_distinct("customer_id").alias("n_customers"),
            n_distinct("item_id").alias("n_items"),
        )
    )
    # Three rows at most.
    total = F.sum("n_rows").over(Window.partitionBy())
    return parts.withColumn("pct", F.col("n_rows") * 100.0 / total)


def history_for(
    df: DataFrame, target: str, ts: str = "updated_date", rule: SplitRule = SplitRule()
) -> DataFrame:
    """Everything that may be known when predicting ``target``."""
    return take(df, ts, HISTORY_OF[target], rule)


def by_target(df: DataFrame, ts: str = "updated_date", rule: SplitRule = SplitRule()) -> DataFrame:
    """All rows once per prediction target and role ("history" or "target") they play, in one pass."""
    roles = {
        part: [
            F.struct(F.lit(target).alias("target"), F.lit(role).alias("role"))
            for target in HISTORY_OF
            for role, known in (("history", HISTORY_OF[target]), ("target", (TARGET_OF[target],)))
            if part in known
        ]
        for part in (TRAIN, VAL, TEST)
    }
    played = None
    for part, found in roles.items():
        mine = F.when(F.col("split") == part, F.array(*found))
        played = mine if played is None else F.coalesce(played, mine)
    return with_part(df, ts, rule).withColumn("as", F.explode(played)).select(*df.columns, "split", "as.*")


def target_rows(
    df: DataFrame, target: str, ts: str = "updated_date", rule: SplitRule = SplitRule()
) -> DataFrame:
    return take(df, ts, (TARGET_OF[target],), rule)


def customers_of(df: DataFrame) -> DataFrame:
    return df.select("customer_id").distinct()


def of_customers(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows of the given (distinct) customers."""
    return lookup(df, customers, "customer_id", "left_semi", row_bytes=16)


def narrowed(df: DataFrame, customers: DataFrame, few: bool) -> DataFrame:
    """Drop rows of other customers before a shuffle, when the list can be broadcast.

    For tables that a later join reduces to these customers anyway: with a long
    list the filter would cost a shuffle of its own and is left out.
    """
    return df.join(F.broadcast(customers), "customer_id", "left_semi") if few else df


def few_customers(customers: DataFrame | None, limit_bytes: int | None = None) -> bool:
    return customers is not None and fits_broadcast(customers, 16, limit_bytes)


def known_customers(target: DataFrame, history: DataFrame) -> DataFrame:
    """Customers of ``target`` that also occur in ``history``."""
    return customers_of(target).join(customers_of(history), "customer_id", "left_semi")


def active_items(items: DataFrame) -> DataFrame:
    """Items on sale."""
    return items.filter(F.col("sale_status") == 1).select("item_id").distinct()


def only_items(df: DataFrame, items: DataFrame, fits: bool | None = None) -> DataFrame:
    """Rows whose item is in the given (distinct) list."""
    return lookup(df, items, "item_id", "left_semi", row_bytes=64, spread="customer_id", fits=fits)
