"""Defaults for every job, as plain values."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Results only agree with earlier runs of the same analysis when
# these stay as they are.
# ---------------------------------------------------------------------------

# Calendar months of each split.
TRAIN_MONTHS = (1, 10)
VAL_MONTH = 11
TEST_MONTH = 12
EVENT_YEAR = 2025

# Weight of one event next to one purchased unit; other types weigh 0.
EVENT_WEIGHTS = {
    "purchase": 1.0,
    "add_to_cart": 0.4,
    "wishlist": 0.2,
    "view": 0.1,
}

# Recommendations per customer.
TOP_K = 10

# Windows and months of the recency counts.
USER_RECENT_DAYS = (30, 60, 90)
ITEM_RECENT_DAYS = (30, 90)
FEATURE_MONTHS = tuple(range(1, 11))
NEW_USER_SPAN_DAYS = 60
NEVER_BOUGHT_DAYS = 9999.0
PRICE_RATIO_OFFSET = 1e-6


@dataclass(frozen=True)
class CandidateLimits:
    """How many items each candidate source may add per customer.

    None lifts the limits ``history``, ``total`` and ``items_per_bill``.
    """

    history: int | None = 200
    covisit: int = 300
    vectors: int = 200
    total: int | None = 1200
    neighbours_per_item: int = 50
    items_per_bill: int | None = 20
    recent_items: int = 20
    decay: float = 0.9


@dataclass(frozen=True)
class AlsParams:
    factors: int = 128
    iterations: int = 20
    regularization: float = 0.01
    alpha: float = 40.0
    # Confidence of an interaction is this plus alpha times its weight.
    confidence_offset: float = 0.0
    seed: int = 42
    # Blocks of customers and of items; 0 derives them from the number of rows.
    user_blocks: int = 0
    item_blocks: int = 0


@dataclass(frozen=True)
class EmbeddingParams:
    vector_size: int = 64
    window: int = 5
    min_count: int = 3
    epochs: int = 10
    # Purchases per training sentence; longer histories become several, each
    # beginning with the last ``window`` purchases of the one before.
    sentence_length: int = 10_000
    # Draws against every pair, and the share of all purchases above which an item
    # takes part less often (0: never).
    negatives: int = 5
    sample: float = 1e-3
    # Shards of the two vector tables; 0 follows the items and the cores.
    shards: int = 0
    seed: int = 42


@dataclass(frozen=True)
class RankerParams:
    trees: int = 500
    learning_rate: float = 0.05
    max_depth: int = 6
    leaves: int = 63
    row_sample: float = 0.8
    column_sample: float = 0.8
    seed: int = 42
    # Customers to train and to evaluate on, and negatives for every positive; 0 takes all.
    train_users: int = 100_000
    negatives_per_positive: int = 20
    eval_users: int = 0
