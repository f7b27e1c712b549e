"""Paired and resampling statistics as DataFrame operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import salt


def everything() -> WindowSpec:
    """One window over all rows: for small, folded tables only."""
    return Window.partitionBy(F.lit(0))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average rank of value: ties share the mean of their places.

    Values are counted first; the running count goes over distinct values only, in two levels.
    """
    per = df.groupBy(F.col(value).alias("rank_v")).agg(F.count("*").alias("rank_n"))
    per = running(per, ["rank_v"], ["rank_n"]).select("rank_v", (F.col("rank_n_upto") - (F.col("rank_n") - 1) / 2.0).alias(out))
    return df.join(per, F.col(value) == F.col("rank_v")).drop("rank_v")


def normal_two_sided(z: Column) -> Column:
    """p of a standard normal statistic, by a fixed series of erfc (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Chebyshev coefficients of erfc.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly: Column = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + F.lit(k)
    return t * F.exp(-x * x + poly)


def wilcoxon(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n (differences that are not 0), w = min(W+, W-), z with tie correction, p."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = average_rank(d, "m", "r")
    ties = d.groupBy("m").agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("ties"))
    s = r.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("down"))
    n = F.col("n").cast("double")
    z = (F.least("up", "down") - n * (n + 1) / 4) / F.sqrt(F.nullif(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0, F.lit(0.0)))
    return s.join(ties).select("n", F.least("up", "down").alias("w"), z.alias("z"), F.least(F.lit(1.0), normal_two_sided(z)).alias("p"))


def cliffs_delta(a: DataFrame, b: DataFrame, value: str = "v") -> DataFrame:
    """One row: delta = (#a>b - #a<b) / (n m), from ranks instead of all cross pairs."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("first")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("first")))
    r = average_rank(both, "v", "r").agg(F.sum("first").alias("n"), F.sum(1 - F.col("first")).alias("m"), F.sum(F.when(F.col("first") == 1, F.col("r"))).alias("ra"))
    return r.select("n", "m", ((2 * F.col("ra") - F.col("n") * (F.col("n") + 1)) / (F.col("n") * F.col("m")) - 1).alias("delta"))


def spearman(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, rho and the two-sided p of t = rho sqrt((n - 2) / (1 - rho^2)); 0 where rho is 1 or -1."""
    r = average_rank(average_rank(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")), "a", "ra"), "b", "rb")
    s = r.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
    free, left = (F.col("n") - 2).cast("double"), 1 - F.col("rho") * F.col("rho")
    t = F.when(left <= 0, F.lit(float("inf"))).otherwise(F.col("rho") * F.sqrt(free / F.nullif(left, F.lit(0.0))))
    return s.withColumn("p", student_two_sided(t, free))


def mcnemar(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Per group from paired correctness flags: n11, n10, n01, n00 and the exact two-sided p."""
    x, y = F.col(a), F.col(b)
    c = pairs.groupBy(*by).agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))

    @F.pandas_udf(DoubleType())
    def exact(k: pd.Series, n: pd.Series) -> pd.Series:
        def p(k: int, n: int) -> float:
            if n == 0:
                return 1.0
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
            return min(1.0, 2 * sum(map(math.exp, logs)))

        return pd.Series([p(int(i), int(j)) for i, j in zip(k, n, strict=True)])

    return c.withColumn("p", exact(F.least("n10", "n01"), F.col("n10") + F.col("n01")))


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """p of Student's t by the continued fraction of the incomplete beta function."""

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        f, c, d = 1.0, 1.0, 0.0
        for i in range(400):
            m = i // 2
            num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d or 1e-30)
            c = 1 + num / c or 1e-30
            f *= c * d
            if abs(1 - c * d) < 1e-13:
                break
        return math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * (f - 1) / a

    return pd.Series([float("nan") if x != x or n != n or n <= 0 else 0.0 if math.isinf(x) else beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)])


def corrected_t(diffs: DataFrame, test_train: float, value: str = "d", by: tuple[str, ...] = ()) -> DataFrame:
    """Per group: j, mean, t of the corrected resampled t-test, p. Zero variance: p is 1 for mean 0, else 0."""
    g = diffs.groupBy(*by).agg(F.count(value).alias("j"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    t = F.col("mean") / F.sqrt((1 / F.col("j") + F.lit(test_train)) * F.nullif(F.col("var"), F.lit(0.0)))
    g = g.withColumn("t", t)
    p = F.when(F.coalesce(F.col("var"), F.lit(0.0)) == 0, F.when(F.col("mean") == 0, 1.0).otherwise(0.0)).otherwise(student_two_sided(F.col("t"), (F.col("j") - 1).cast("double")))
    return g.select(*by, "j", "mean", "t", p.alias("p"))


def holm(ps: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """ps with ``adjusted``: step-down with running maximum, capped at 1; null stays null."""
    known = ps.where(F.col(p).isNotNull())
    order = everything().orderBy(p, key)
    raw = known.withColumn("holm_raw", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(everything()) - F.row_number().over(order) + 1)))
    done = raw.withColumn("adjusted", F.max("holm_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("holm_raw")
    return done.unionByName(ps.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def mean_diff_ci(diffs: DataFrame, value: str = "d", by: tuple[str, ...] = ()) -> DataFrame:
    se = F.stddev_samp(value) / F.sqrt(F.count(value))
    return diffs.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - 1.96 * se).alias("lo"), (F.avg(value) + 1.96 * se).alias("hi"), F.stddev_pop(value).alias("std_pop"))


def in_order(rows: DataFrame, order: list[str], down: bool = False) -> DataFrame:
    """rows in one order, written: sort_id grows with it, and sort_part is the part of the range sort that a row is in.

    Nulls come first, or last if down.  Rows that are equal in ``order`` are taken in any order.
    """
    from ..runtime import materialize

    keys = [F.col(c).desc() if down else F.col(c).asc() for c in order]
    s = materialize(rows.orderBy(*keys).withColumn("sort_id", F.monotonically_increasing_id()), "sorted")
    return s.withColumn("sort_part", F.shiftright("sort_id", 33))


def running_in_order(s: DataFrame, values: list[str]) -> DataFrame:
    """What in_order() gives, with a column v_upto per value: its sum over the rows up to and with this one.

    The sums of the few parts give each its offset, and a part is summed up on its own.
    """
    sums = s.groupBy(F.col("sort_part").alias("sums_of")).agg(*[F.sum(v).alias(f"sort_{v}") for v in values])
    before = everything().orderBy("sums_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sums_of", *[F.coalesce(F.sum(f"sort_{v}").over(before), F.lit(0)).alias(f"sort_{v}") for v in values])
    inside = Window.partitionBy("sort_part").orderBy("sort_id").rowsBetween(Window.unboundedPreceding, 0)
    j = s.select("*", *[F.sum(v).over(inside).alias(f"{v}_upto") for v in values]).join(sums, F.col("sort_part") == F.col("sums_of"))
    return j.select(*s.columns, *[(F.col(f"{v}_upto") + F.col(f"sort_{v}")).alias(f"{v}_upto") for v in values])


def running(rows: DataFrame, order: list[str], values: list[str], down: bool = False) -> DataFrame:
    """rows with a column v_upto per value: its sum over the rows up to and with this one, without one task for all rows."""
    return running_in_order(in_order(rows, order, down), values).drop("sort_id", "sort_part")


def quantiles(per: DataFrame, points: list[float]) -> DataFrame:
    """(point, value): linear quantiles of values counted in per(score, n), for a constant list of points.

    The value at place h = point * (N - 1), between its neighbours; no task sees more than
    its part of the distinct values.
    """
    upto = running(per.select("score", "n"), ["score"], ["n"])
    total = per.agg(F.sum("n")).collect()[0][0]
    if not total:
        return per.select(F.lit(0.0).alias("point"), F.col("score").cast("double").alias("value")).limit(0)
    at = [(float(p), int(p * (total - 1)), min(int(p * (total - 1)) + 1, total - 1), p * (total - 1) - int(p * (total - 1))) for p in points]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (_, lo, hi, _) in enumerate(at) for k in (lo, hi)])
    # places [n_upto - n, n_upto) hold this value
    hit = upto.select("score", F.explode(F.filter(wanted, lambda w: (w["k"] >= F.col("n_upto") - F.col("n")) & (w["k"] < F.col("n_upto")))).alias("w"))
    both = hit.groupBy(F.col("w.i").alias("i")).agg(F.min("score").cast("double").alias("lo"), F.max("score").cast("double").alias("hi"))
    share = F.array(*[F.lit(f) for *_, f in at])
    point = F.array(*[F.lit(p) for p, *_ in at])
    return both.select(F.get(point, F.col("i")).alias("point"), (F.col("lo") + (F.col("hi") - F.col("lo")) * F.get(share, F.col("i"))).alias("value"))


def grouped_quantiles(rows: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """(by..., q): linear quantiles of value per group, an array in the order of points; nulls do not count.

    Values are counted per group and put in one order, so no task holds a group.  by may be
    empty: one row, or none for an empty table.
    """
    from ..runtime import materialize

    per = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(c) for c in by], F.col(value).alias("gq_v")).agg(F.count("*").alias("gq_n"))
    u = materialize(running(per, [*by, "gq_v"], ["gq_n"]), "quantiles")
    g = u.groupBy(*[F.col(c).alias(f"gq_{c}") for c in by]).agg(F.min(F.col("gq_n_upto") - F.col("gq_n")).alias("gq_start"), F.sum("gq_n").alias("gq_total"))
    j = u.join(F.broadcast(g)) if not by else u.join(g, [F.col(c).eqNullSafe(F.col(f"gq_{c}")) for c in by])  # without groups, one row
    end = F.col("gq_n_upto") - F.col("gq_start")
    places = []
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("gq_total") - 1)
        low = F.floor(at)
        places += [F.struct(F.lit(i).alias("i"), k.alias("k"), (at - low).alias("f")) for k in (low, F.least(low + 1, F.col("gq_total") - 1))]
    hit = j.select(*by, "gq_v", F.explode(F.filter(F.array(*places), lambda w: (w["k"] >= end - F.col("gq_n")) & (w["k"] < end))).alias("w"))
    both = hit.groupBy(*by, F.col("w.i").alias("i")).agg((F.min("gq_v") + (F.max("gq_v") - F.min("gq_v")) * F.max("w.f")).cast("double").alias("v"))
    # two rows at most per point and group
    return both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q")).where(F.size("q") > 0)


def numbered(rows: DataFrame, order: str, out: str = "place") -> DataFrame:
    """rows with their 0-based place in an order, without one task for all rows.

    A range sort is written; ids grow with partition and place, and the counts of the few
    partitions give each its offset.
    """
    from ..runtime import materialize

    s = materialize(rows.orderBy(order).withColumn("sort_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("sort_id", 33)
    counts = s.groupBy(part.alias("sort_part")).agg(F.count("*").alias("sort_n"))
    before = F.sum("sort_n").over(everything().orderBy("sort_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sort_n")
    counts = counts.select("sort_part", before.alias("sort_before"))
    j = s.withColumn("sort_own", part).join(counts, F.col("sort_own") == F.col("sort_part"))
    return j.withColumn(out, F.col("sort_before") + F.col("sort_id") - F.shiftleft(F.col("sort_own"), 33)).drop("sort_id", "sort_own", "sort_part", "sort_before")


def resamples(rows: DataFrame, order: str, b: int, seed: str) -> DataFrame:
    """rows drawn b times with replacement: the columns of rows, with ``resample``.

    Draw i of resample r takes place md5(seed, r, i) mod n.  Each row is joined to its
    draws, so the work is b times the rows; counts per place are folded first.
    """
    placed = numbered(rows, order)
    n = placed.count()
    draws = (
        placed.select(F.col("place").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("resample"))
        .select("resample", F.pmod(salt(seed, F.col("resample"), F.lit("/"), F.col("i")), F.lit(max(1, n))).alias("hit")).groupBy("resample", "hit").agg(F.count("*").alias("times"))
    )
    return placed.join(draws, F.col("place") == F.col("hit")).drop("hit", "place")


def order_statistics(stats: DataFrame, value: str, b: int, level: float = 0.95, linear: bool = False) -> DataFrame:
    """lo, hi: places int(2.5% b) and int(97.5% b) - 1 of the sorted resample statistics, or the interpolated percentiles.

    The b statistics of a resampling are one row each, so their array is bounded by b.
    """
    if linear:
        q = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
        return stats.agg(q.alias("q")).select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    lo, hi = int((1 - level) / 2 * b), int((1 + level) / 2 * b) - 1
    s = stats.agg(F.sort_array(F.collect_list(value)).alias("s"))
    return s.select(F.get("s", F.lit(lo)).alias("lo"), F.get("s", F.lit(hi)).alias("hi"))


def bootstrap_mean(rows: DataFrame, value: str, order: str, b: int = 1000, seed: str = "boot", linear: bool = False) -> DataFrame:
    means = resamples(rows.select(order, value), order, b, seed).groupBy("resample").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m"))
    return order_statistics(means, "m", b, linear=linear)
