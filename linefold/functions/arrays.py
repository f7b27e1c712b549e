"""Column helpers on arrays: sets, vectors, rankings of metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ratio


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    return ratio(overlap(a, b), F.size(F.array_union(a, b)), both_empty)


def containment(sig: Column, query: Column) -> Column:
    """Share of a signature's features that the query has; 0 for an empty signature."""
    return ratio(overlap(sig, query), F.size(F.array_distinct(sig)))


def coverage(region: Column, wanted: Column) -> Column:
    return ratio(overlap(region, wanted), F.size(F.array_distinct(wanted)), None)


def region_or_whole(region: Column, n: Column) -> Column:
    """A region, or all lines where it is empty."""
    return F.when((F.size(region) == 0) & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(region)


def region_text(lines: Column, region: Column, empty: str = " ") -> Column:
    # lines stand outside of the lambda, where they are split once and not for every line kept
    kept = F.array_join(F.filter(lines, lambda _, i: F.array_contains(region, i)), "\n")
    return F.when(F.size(region) == 0, F.lit(empty)).otherwise(kept)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def pad_ids(ids: Column, n: int, pad: int = 0) -> Column:
    """Cut or pad to n ids."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)


def in_region(features: Column, region: Column | None) -> Column:
    """Features {line, feat} whose 1-based line is in the 0-based region; all where region is None."""
    return features if region is None else F.filter(features, lambda f: (f["line"] >= 1) & F.array_contains(region, f["line"] - 1))


def or_whole(part: Column, whole: Column) -> Column:
    return F.when(F.size(part) == 0, whole).otherwise(part)
