"""The items with the largest total weight, the same for everybody."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketrank.functions.joins import lookup
from basketrank.functions.ordering import dense_index
from basketrank.functions.scan import is_long, running
from basketrank.models.base import Recommender


def popularity_ranking(interactions: DataFrame) -> DataFrame:
    """(item_id, weight, rank): items by total weight, ranked from 1."""
    totals = interactions.groupBy("item_id").agg(F.sum("weight").alias("weight"))
    return dense_index(totals, [F.col("weight").desc(), F.col("item_id")], "rank", start=1)


class PopularityModel(Recommender):
    def __init__(self, ranking: DataFrame) -> None:
        self.ranking = ranking

    @classmethod
    def fit(cls, interactions: DataFrame) -> PopularityModel:
        return cls(popularity_ranking(interactions))

    def recommend(
        self,
        customers: DataFrame,
        k: int,
        seen: DataFrame | None = None,
        limit_bytes: int | None = None,
    ) -> DataFrame:
        """The first ``k`` ranks that each customer has not seen.

        Works on the gaps between seen ranks: behind the j-th seen rank r lie
        unseen ranks, the list is full at rank k + j, so the gap contributes the
        ranks from r + 1 up to the next seen rank or k + j. Exactly k rows per
        customer are produced, whatever the size of the catalogue.
        """
        edges = customers.select("customer_id", F.lit(0).cast("bigint").alias("rank"))
        if seen is not None:
            mine = lookup(
                seen.select("customer_id", "item_id"), customers.select("customer_id"),
                "customer_id", "left_semi", row_bytes=16, limit_bytes=limit_bytes, spread="item_id",
            )
            ranked = lookup(
                mine, self.ranking.select("item_id", "rank"), "item_id", "inner",
                row_bytes=64, limit_bytes=limit_bytes, spread="customer_id",
            )
            edges = edges.unionByName(ranked.select("customer_id", "rank"))
        # A customer has at most as many edges as there are ranks.
        placed = running(
            edges, "customer_id", "rank", number="j", following="next", split=is_long(self.ranking, "rank")
        )
        gaps = placed.withColumn("j", F.col("j") - 1)
        end = F.least(F.col("next") - 1, F.col("j") + k)  # least() skips a null
        places = (
            gaps.withColumn("end", end)
            .filter(F.col("rank") < F.col("end"))
            .select(
                "customer_id", "j", F.explode(F.sequence(F.col("rank") + 1, F.col("end"))).alias("rank")
            )
            .select("customer_id", "rank", (F.col("rank") - F.col("j")).cast("int").alias("pos"))
        )
        # Every customer asks for the same few ranks, hence the split of heavy keys.
        return lookup(
            places, self.ranking.select("rank", "item_id"), "rank", "inner",
            row_bytes=64, limit_bytes=limit_bytes, spread="customer_id",
        ).select("customer_id", "item_id", "pos")

    def save(self, path: str) -> None:
        self.ranking.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PopularityModel:
        return cls(spark.read.parquet(path))
