"""Tunable values. The defaults are fixed values shared with the system being matched."""

from __future__ import annotations

from dataclasses import dataclass

# The nine product fields, in their storage order.
PRODUCT_FIELDS = (
    "title",
    "price",
    "currency",
    "in_stock",
    "rating",
    "review_count",
    "sku",
    "brand",
    "description",
)

# The fields that decide the confidence score.
CRITICAL_FIELDS = ("title", "price", "in_stock")

DEFAULT_SCHEMA_NAME = "product_v1"
DEFAULT_TTL_SECONDS = 604_800
MAX_SECTION_CHARS = 15_000
MIN_SECTION_CHARS = 500


@dataclass(frozen=True)
class DriftParams:
    """Similarity limits below which a page counts as changed, and the n-gram width."""

    structural_threshold: float = 0.85
    visual_threshold: float = 0.80
    shingle_size: int = 3


@dataclass(frozen=True)
class RegistryParams:
    """Lifetime and failure-rate limits of stored selectors."""

    ttl_seconds: int = DEFAULT_TTL_SECONDS
    max_null_rate: float = 0.25
    min_samples: int = 5
