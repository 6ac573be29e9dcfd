"""One model on weighted interactions: train and evaluate, or predict.

    python -m basketrank.jobs.single_stage train --transactions T --items I --out O
    python -m basketrank.jobs.single_stage predict --transactions T --items I --out O
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from basketrank import config
from basketrank.config import AlsParams
from basketrank.functions.staging import release, stage
from basketrank.jobs.common import Places, parser, rule_of, session, show_row, tables_of
from basketrank.models.als import AlsRecommender
from basketrank.models.base import Recommender
from basketrank.models.popularity import PopularityModel
from basketrank.operators import split
from basketrank.operators.evaluate import evaluate
from basketrank.operators.interactions import interactions, purchased_items
from basketrank.sources.sinks import prediction_lists, write_lists, write_metrics
from basketrank.sources.tables import Tables

MODELS: dict[str, type[Recommender]] = {"als": AlsRecommender, "popularity": PopularityModel}
# What counts as already seen: everything with a weight, or purchases only.
EXCLUDE = ("interactions", "purchases")

_TS = "updated_date"


def _seen(pairs: DataFrame, tables: Tables, rule: split.SplitRule, exclude: str) -> DataFrame:
    if exclude == "interactions":
        return pairs.select("customer_id", "item_id")
    return purchased_items(split.take(tables.transactions, _TS, (split.TRAIN,), rule))


def train(
    spark: SparkSession,
    tables: Tables,
    out: Places,
    model: str = "als",
    use_events: bool = False,
    k: int = config.TOP_K,
    als: AlsParams = AlsParams(),
    rule: split.SplitRule = split.SplitRule(),
    event_year: int = config.EVENT_YEAR,
    exclude: str = EXCLUDE[0],
    evaluate_model: bool = True,
) -> DataFrame | None:
    """Fit and save the model; returns the validation metrics, one row."""
    events = None
    if use_events:
        if tables.events is None:
            raise ValueError("use_events needs an events table")
        event_rule = replace(rule, year=event_year)
        events = split.take(tables.events, "event_date", (split.TRAIN,), event_rule)
    history = split.take(tables.transactions, _TS, (split.TRAIN,), rule)
    # Kept next to the model: prediction leaves out the same pairs.
    place = out.model(f"{model}_interactions")
    interactions(history, events).write.mode("overwrite").parquet(place)
    pairs = spark.read.parquet(place)
    fitted = AlsRecommender.fit(pairs, als) if model == "als" else PopularityModel.fit(pairs)
    fitted.save(out.model(model))
    if not evaluate_model:
        return None
    val = split.take(tables.transactions, _TS, (split.VAL,), rule)
    known = stage(split.known_customers(val, pairs), "customers")
    lists = stage(fitted.recommend(known, k, _seen(pairs, tables, rule, exclude)), "lists")
    # The popularity model answers for every customer, even with an empty list.
    metrics = evaluate(lists, val, k, known)
    write_metrics(metrics, out.report("val_metrics"))
    return spark.read.json(out.report("val_metrics"))


def predict(
    spark: SparkSession,
    tables: Tables,
    out: Places,
    model: str = "als",
    target: str = split.TEST,
    k: int = config.TOP_K,
    rule: split.SplitRule = split.SplitRule(),
    exclude: str = EXCLUDE[0],
) -> DataFrame:
    """Write the lists of the target month's customers with a history; returns them."""
    fitted = MODELS[model].load(spark, out.model(model))
    pairs = spark.read.parquet(out.model(f"{model}_interactions"))
    wanted = split.target_rows(tables.transactions, target, _TS, rule)
    known = stage(split.known_customers(wanted, pairs), "customers")
    rows = fitted.recommend(known, k, _seen(pairs, tables, rule, exclude))
    path = out.predictions(f"predictions_{target}")
    write_lists(prediction_lists(rows, known), path, "overwrite")
    return spark.read.json(path)


def main() -> None:
    args_parser = parser(__doc__)
    args_parser.add_argument("step", choices=["train", "predict"])
    args_parser.add_argument("--model", choices=list(MODELS), default="als")
    args_parser.add_argument("--top-k", type=int, default=config.TOP_K)
    args_parser.add_argument("--target-split", choices=[split.VAL, split.TEST], default=split.TEST)
    args_parser.add_argument("--use-events", action="store_true")
    args_parser.add_argument("--exclude", choices=EXCLUDE, default=EXCLUDE[0])
    args_parser.add_argument("--factors", type=int, default=AlsParams.factors)
    args_parser.add_argument("--iterations", type=int, default=AlsParams.iterations)
    args_parser.add_argument("--alpha", type=float, default=AlsParams.alpha)
    args_parser.add_argument("--user-blocks", type=int, default=0, help="0: from the interactions")
    args_parser.add_argument("--item-blocks", type=int, default=0, help="0: from the items")
    args_parser.add_argument("--no-eval", action="store_true")
    args = args_parser.parse_args()
    spark = session(f"basketrank-{args.step}")
    tables, out, rule = tables_of(spark, args), Places(args.out), rule_of(args)
    if args.step == "train":
        als = AlsParams(
            factors=args.factors, iterations=args.iterations, alpha=args.alpha,
            user_blocks=args.user_blocks, item_blocks=args.item_blocks,
        )
        split.split_stats(tables.transactions, _TS, rule).show()
        metrics = train(
            spark, tables, out, args.model, args.use_events, args.top_k, als, rule,
            args.year or config.EVENT_YEAR, args.exclude, not args.no_eval,
        )
        if metrics is not None:
            show_row(metrics)
    else:
        lists = predict(
            spark, tables, out, args.model, args.target_split, args.top_k, rule, args.exclude
        )
        lists.show(3, truncate=False)
    release(spark)


if __name__ == "__main__":
    main()
