"""Write transactions (and events) into month folders, which the splits prune.

    python -m basketrank.jobs.prepare --transactions T --items I [--events E] --out O
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from basketrank.jobs.common import Places, parser, session, tables_of
from basketrank.sources.tables import Tables, write_by_month


def run(spark: SparkSession, tables: Tables, out: Places) -> None:
    write_by_month(tables.transactions, out.report("transactions"), "updated_date", "bill_id", "item_id")
    if tables.events is not None:
        write_by_month(tables.events, out.report("events"), "event_date", "item_id")


def main() -> None:
    args = parser(__doc__).parse_args()
    spark = session("basketrank-prepare")
    run(spark, tables_of(spark, args), Places(args.out))


if __name__ == "__main__":
    main()
