"""Samples and cross-validation folds, by md5 so that other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import salt
from ..runtime import materialize
from .statistics import numbered


def hash_order(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))


def balanced_sample(rows: DataFrame, label: str, key: str, cap: int, ratio: int = 4, seed: str = "sample") -> DataFrame:
    """At most cap // (1 + ratio) positives and ratio times as many negatives, by hash order.

    A top-k by hash per label: sampling is the feature here.
    """
    pos = cap // (1 + ratio)
    k = lambda v, n: rows.where(F.col(label) == v).orderBy(hash_order(seed, key), key).limit(n)
    positives = k(1, pos)
    return positives.unionByName(k(0, pos * ratio))


def _dealt(rows: DataFrame, by: list[str], h: Column, key: str, n: int) -> DataFrame:
    """rows with ``fold``: within the columns ``by``, places in the order of the hash h dealt round.

    Places are taken in two levels, cells of the hash and places inside a cell, so that a
    label with most of the rows is dealt over many tasks.
    """
    keyed = rows.withColumn("fold_h", h).withColumn("fold_cell", F.substring("fold_h", 1, 3))
    cells = keyed.groupBy(*[F.col(c).alias(f"cell_{c}") for c in by], F.col("fold_cell").alias("cell")).agg(F.count("*").alias("cell_n"))
    own = [f"cell_{c}" for c in by]
    upto = F.sum("cell_n").over(Window.partitionBy(*own).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("cell_before", upto - F.col("cell_n"))
    place = F.row_number().over(Window.partitionBy(*by, "fold_cell").orderBy("fold_h", key))
    on = F.col("fold_cell") == F.col("cell")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"cell_{c}"))
    out = keyed.withColumn("place", place).join(cells, on)
    return out.withColumn("fold", F.pmod(F.col("cell_before") + F.col("place") - 1, F.lit(n)).cast("bigint")).drop("fold_h", "fold_cell", "place", "cell", "cell_n", "cell_before", *own)


def stratified_folds(rows: DataFrame, label: str, key: str, n: int = 5, seed: str = "fold") -> DataFrame:
    """rows with ``fold``: per label, places in hash order dealt round."""
    return _dealt(rows, [label], hash_order(seed, key), key, n)


def repeated_folds(rows: DataFrame, label: str, key: str, repeats: int = 30, n: int = 5, seed: str = "fold") -> DataFrame:
    """(repeat, fold) for every row, the repeat in the hash's seed."""
    many = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))).alias("repeat"))
    h = F.md5(F.concat(F.lit(seed), F.col("repeat").cast("string"), F.lit("/"), F.col(key).cast("string")).cast("binary"))
    return _dealt(many, ["repeat", label], h, key, n)


def group_folds(rows: DataFrame, group: str, n: int = 5, seed: str = "group") -> DataFrame:
    """rows with ``fold`` by hash of the group: a group is never split."""
    return rows.withColumn("fold", F.pmod(salt(seed, F.coalesce(F.col(group).cast("string"), F.lit(""))), F.lit(n)))


def greedy(groups: list[tuple[int, int]], held: list[list[int]], total: tuple[int, int]) -> list[int]:
    """Folds of groups (pos, neg), one after another: each to the fold where the squared shares of both labels grow least.

    held: (pos, neg) of every fold so far, kept up to date.  Ties go to the fold with fewer
    rows, then to the first.  Whole numbers: exact at every size.
    """
    pos, neg = max(1, total[0]), max(1, total[1])
    out = []
    for p, q in groups:
        k = min(range(len(held)), key=lambda i: (held[i][0] * p * neg * neg + held[i][1] * q * pos * pos, sum(held[i]), i))
        held[k][0] += p
        held[k][1] += q
        out.append(k)
    return out


def stratified_group_folds(rows: DataFrame, group: str, label: str, n: int = 5, heavy: int = 1000) -> DataFrame:
    """rows with ``fold``: no group is split, and folds are even in the labels 0 and 1; rows of other labels go with their group and do not count.

    Groups with more than 1 / heavy of all rows, fewer than ``heavy``, are dealt exactly, one
    after another, to the fold that they upset least.  The long tail goes before them: by
    falling size, then falling positives, dealt round in one order over all groups.  Sizes
    fall along that order, so folds of the tail differ by at most one group of its largest
    size in rows, and by at most the sum of its different sizes in positives; the heavy groups
    then even this out.
    """
    g = F.col(group).cast("string")
    counts = materialize(rows.groupBy(g.alias("g")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")), "group-counts")
    pos, neg = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).collect()[0]
    size = F.col("pos") + F.col("neg")
    large = (size * heavy) > pos + neg
    tail = numbered(counts.where(~large).withColumn("key", F.struct((-size).alias("size"), (-F.col("pos")).alias("pos"), "g")), "key")
    tail = materialize(tail.select("g", F.pmod("place", F.lit(n)).cast("bigint").alias("fold"), "pos", "neg"), "group-tail")
    held = [[0, 0] for _ in range(n)]
    for r in tail.groupBy("fold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():
        held[r["fold"]] = [r["pos"], r["neg"]]
    # fewer than ``heavy`` groups: each has more than that part of the rows
    top = counts.where(large).orderBy(size.desc(), F.col("pos").desc(), F.col("g").asc_nulls_first()).collect()
    dealt = [(r["g"], k) for r, k in zip(top, greedy([(r["pos"], r["neg"]) for r in top], held, (pos, neg)), strict=True)]
    table = tail.select(F.col("g").alias("fold_group"), "fold").unionByName(rows.sparkSession.createDataFrame(dealt, "fold_group string, fold bigint"))
    return rows.join(table, g.eqNullSafe(F.col("fold_group"))).drop("fold_group")
