"""Completeness measures of records, selector maps and extraction results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.params import CRITICAL_FIELDS, PRODUCT_FIELDS


def _share(flags: Iterable[Column], total: int) -> Column:
    count = F.lit(0)
    for flag in flags:
        count = count + flag.cast("int")
    return count.cast("double") / F.lit(float(total))


def record_null_rate() -> Column:
    """Share of the nine typed fields that are NULL."""
    return _share((F.col(f).isNull() for f in PRODUCT_FIELDS), len(PRODUCT_FIELDS))


def record_confidence() -> Column:
    """Share of the critical fields that are present."""
    return _share((F.col(f).isNotNull() for f in CRITICAL_FIELDS), len(CRITICAL_FIELDS))


def selector_coverage(selectors: Column) -> Column:
    """Share of the nine fields that have a selector."""
    return _share(
        (F.try_element_at(selectors, F.lit(f)).isNotNull() for f in PRODUCT_FIELDS),
        len(PRODUCT_FIELDS),
    )


def null_count(results: Column) -> Column:
    return F.size(F.filter(F.map_values(results), lambda v: v.isNull()))


def result_null_rate(results: Column) -> Column:
    """Share of fields without a value; an empty result counts as entirely missing."""
    return F.when(F.size(results) == 0, F.lit(1.0)).otherwise(
        null_count(results).cast("double") / F.size(results).cast("double")
    )


def known_fields(values: Column) -> Column:
    """Drop map keys outside the product record."""
    return F.map_filter(values, lambda k, v: k.isin(*PRODUCT_FIELDS))


def validity_report(results: Column) -> Column:
    """field -> (valid, value)."""
    return F.transform_values(
        results, lambda k, v: F.struct(v.isNotNull().alias("valid"), v.alias("value"))
    )


def failure_rate(hits: Column, misses: Column) -> Column:
    total = F.coalesce(hits, F.lit(0)) + F.coalesce(misses, F.lit(0))
    return F.when(
        total > 0, F.coalesce(misses, F.lit(0)).cast("double") / total.cast("double")
    ).otherwise(F.lit(0.0))
