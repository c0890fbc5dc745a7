"""Structural fingerprints of HTML as column expressions.

The skeleton of a page is the document-order list of its start tags with a few kept
attributes, so it needs a tokeniser and no tree. Everything here is one narrow projection
without a shuffle: Arrow batches of pages become lines, the rest is native.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import skeleton
from driftloom.shipping import ship_package


@cache
def _lines():
    return F.arrow_udf(skeleton.lines_of, T.ArrayType(T.StringType()))


def skeleton_lines(html: Column) -> Column:
    """The page skeleton: one line per start tag; ``functions.skeleton`` reads the page inside the task."""
    ship_package(SparkSession.active())
    return _lines()(html)


def skeleton_text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def structural_hash(lines: Column) -> Column:
    """SHA-256 of the skeleton; an identity, never a distance."""
    return F.sha2(skeleton_text(lines), 256)


def _windows(lines: Column, size: int, shape) -> Column:
    count = F.size(lines)
    starts = F.sequence(F.lit(1), F.greatest(count - size + 1, F.lit(1)))
    return F.array_distinct(
        F.when(count < size, F.transform(lines, lambda line: shape([line]))).otherwise(
            F.transform(
                starts,
                lambda i: shape([F.element_at(lines, i + offset) for offset in range(size)]),
            )
        )
    )


def shingles(lines: Column, size: int = 3) -> Column:
    """Distinct n-grams of consecutive lines as text; single lines when there are fewer than n."""
    return _windows(lines, size, lambda parts: F.concat_ws("\n", *parts))


def shingle_hashes(lines: Column, size: int = 3) -> Column:
    """The same set as 64-bit hashes: eight bytes per shingle in every shuffle and state."""
    return _windows(lines, size, lambda parts: F.xxhash64(*parts))
