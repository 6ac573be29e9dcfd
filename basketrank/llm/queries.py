"""The dealt operators as registered queries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketrank.llm import (
    bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    hard_negatives,
    language,
    line_dedup,
    ngram_join,
    secret_scan,
    spelling,
    toxicity,
    warc,
    wrappers,
)
from basketrank.llm.common import table
from basketrank.llm.twins import SQL

__all__ = ["QUERIES", "SQL"]


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, folder, "documents"), words=4, percent=85)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), bpe.TOKENIZER)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans = secret_scan.find_secrets(table(spark, folder, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return spans.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(joined(of(*secret_scan.BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


#: The text of a planted conversation; it holds every control string of the template.
PLANTED_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(chat_format.ASSISTANT).alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    return chat_format.read_back(chat_format.examples(given.unionByName(planted)))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language": op5_language,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling": op12_spelling,
    "op13_chat_format": op13_chat_format,
}
