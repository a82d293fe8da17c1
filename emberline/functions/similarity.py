"""Set similarity and term hits inside a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jaccard(left: Column, right: Column) -> Column:
    """Distinct intersection over distinct union; 0 when both sides are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def burst_hits(text: Column, terms: Column) -> Column:
    """How many of ``terms`` occur in the lower-case text."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))).cast("bigint")
