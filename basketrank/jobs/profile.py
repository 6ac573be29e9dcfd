"""Profile the tables, summarise the split and export the truth of the test month.

    python -m basketrank.jobs.profile --transactions T --items I --events E --out O
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketrank import config
from basketrank.functions.staging import release
from basketrank.jobs.common import Places, parser, rule_of, session, show_row, tables_of
from basketrank.operators import profile, split
from basketrank.operators.evaluate import truth_lists
from basketrank.sources.sinks import write_lists
from basketrank.sources.tables import Tables

_KEYS = {"customer_id": "n_customers", "item_id": "n_items"}


def reports(
    tables: Tables, rule: split.SplitRule, event_year: int = config.EVENT_YEAR
) -> dict[str, DataFrame]:
    """All report tables by name; each is small."""
    tx, items, events = tables.transactions, tables.items, tables.events
    out = {
        "transactions": profile.table_profile(tx, "updated_date", _KEYS),
        "items": profile.table_profile(items, distinct={"item_id": "n_items"}),
        "categories": profile.value_counts(items, "category_l1"),
        "months": profile.monthly_distribution(tx, "updated_date"),
        "split": split.split_stats(tx, "updated_date", rule),
    }
    if events is not None:
        kinds = _KEYS | {"event_type": "n_types"}
        out["events"] = profile.table_profile(events, "event_date", kinds)
        out["event_types"] = profile.value_counts(events, "event_type")
        event_rule = split.SplitRule(rule.train, rule.val, rule.test, event_year)
        out["event_split"] = split.split_stats(events, "event_date", event_rule)
    return out


def run(
    spark: SparkSession,
    tables: Tables,
    out: Places,
    rule: split.SplitRule = split.SplitRule(),
    event_year: int = config.EVENT_YEAR,
) -> None:
    for name, table in reports(tables, rule, event_year).items():
        table.write.mode("overwrite").json(out.report(f"profile/{name}"))
    truth = truth_lists(split.take(tables.transactions, "updated_date", (split.TEST,), rule))
    write_lists(truth, out.predictions("ground_truth_test"), "overwrite")


def main() -> None:
    args = parser(__doc__).parse_args()
    spark = session("basketrank-profile")
    tables = tables_of(spark, args)
    for table in (tables.transactions, tables.items, tables.events):
        if table is not None:
            table.printSchema()
            profile.preview(table).show()
    out = Places(args.out)
    run(spark, tables, out, rule_of(args), args.year or config.EVENT_YEAR)
    show_row(spark.read.json(out.report("profile/transactions")))
    spark.read.json(out.report("profile/split")).show()
    release(spark)


if __name__ == "__main__":
    main()
