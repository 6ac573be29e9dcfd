"""A training corpus from raw documents, in five stages.

Every stage takes the documents that its predecessor kept, whole, and decides on
them; all but the last return the columns of ``documents``. Between stages the
rows are written as Parquet, so a lost executor costs at most one stage.

1. language: texts without a letter, or without any n-gram of a learned
   language, go.
2. exact_dedup: of equal texts the largest id stays.
3. near_dedup: of documents linked by similar sets of five-word shingles
   (Jaccard 0.8 or more) the smallest id stays.
4. decontaminate: documents that hold a benchmark window go.
5. bpe: token counts and digests of what is left.

``run`` returns the last stage's rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketrank.functions.staging import stage
from basketrank.llm import bpe, decontaminate, exact_dedup, language, ngram_join
from basketrank.llm.common import table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unidentified(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.TOKENIZER)


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_of_similar),
    ("decontaminate", keep_clean_of_benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"corpus-{name}")
    return docs


# A trained language model has no SQL; tests compare ``run`` with a plain version.
ORACLE_SQL = None
