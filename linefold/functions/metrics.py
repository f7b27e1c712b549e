"""Aggregate and scalar expressions of detectors: P, R, F1, MCC, lift and kin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ratio


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def balanced_accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    return ratio(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c)))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn as bigint."""
    return [
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    ]


def lift(cov: Column, random_cov: Column) -> Column:
    """A ratio of means, not a mean of ratios."""
    return F.avg(cov) / F.nullif(F.avg(random_cov), F.lit(0.0))


def nearest_rank(values: Column, p: float) -> Column:
    """Aggregate: the value at place min(n - 1, floor(p n)) of the sorted values.

    Exact and without collecting a group: the discrete percentile over value counts would
    take the ceiling, so the count shifts the fraction by one place.
    """
    return F.element_at(F.sort_array(F.collect_list(values)), F.least(F.count(values), F.floor(F.lit(p) * F.count(values)) + 1).cast("int"))


def random_order_ifa(n: Column, d: Column) -> Column:
    return (n - d) / (d + 1).cast("double")


def random_order_effort(n: Column, d: Column) -> Column:
    return d * (n + 1) / (d + 1).cast("double") / n


def random_order_topk(n: Column, d: Column, k: int) -> Column:
    """1 - prod over j < k of (n - d - j) / (n - j)."""
    miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, j: F.when(n - j <= 0, F.lit(0.0)).otherwise(a * F.greatest(F.lit(0), n - d - j) / F.greatest(F.lit(1), n - j).cast("double"))
    )
    return 1 - miss


def random_order_cdf(n: Column, d: Column, most: int) -> Column:
    """For k = 0..most, the chance that the first k of n lines in random order hold one of d: 1 - prod (n - d - j) / (n - j)."""
    step = lambda a, j: F.when(j >= n, a["p"]).otherwise(a["p"] * F.greatest(F.lit(0), n - d - j) / (n - j).cast("double"))
    start = F.struct(F.lit(1.0).alias("p"), F.array(F.lit(0.0)).alias("out"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(most - 1)), start, lambda a, j: F.struct(step(a, j).alias("p"), F.concat(a["out"], F.array(1 - step(a, j))).alias("out")), lambda a: a["out"]
    )


def always_positive_f1(pos: Column, n: Column) -> Column:
    p = pos.cast("double") / n
    return 2 * p / (1 + p)


def random_guess_f1(pos: Column, n: Column) -> Column:
    """F1 of a fair coin: precision p, recall one half."""
    p = pos.cast("double") / n
    return p / (p + 0.5)


def insertion_counts(n_deleted: Column, n_anchors: Column) -> list[Column]:
    """Aggregates: pairs with any insertion, and pairs that only insert."""
    return [F.count_if(n_anchors > 0).alias("n_with_insertions"), F.count_if((n_anchors > 0) & (n_deleted == 0)).alias("n_insertion_only")]
