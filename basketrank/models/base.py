"""What every recommender offers."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession


class Recommender(ABC):
    """Fitted on (customer_id, item_id, weight), recommends items to customers."""

    @classmethod
    @abstractmethod
    def fit(cls, interactions: DataFrame) -> Recommender:
        """Learn from interactions."""

    @abstractmethod
    def recommend(self, customers: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
        """(customer_id, item_id, pos) for distinct ``customers``.

        ``seen`` holds distinct (customer_id, item_id) pairs to leave out:
        interactions to skip everything touched, purchases to skip what was bought.
        """

    @abstractmethod
    def save(self, path: str) -> None:
        """Write the model below ``path``."""

    @classmethod
    @abstractmethod
    def load(cls, spark: SparkSession, path: str) -> Recommender:
        """Read a saved model."""
