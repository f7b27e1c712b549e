"""Threshold sweeps and ranked metrics over scores; nearest signatures are in nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from .statistics import quantiles, running


def tau_sweep(scores: DataFrame, taus: list[float]) -> DataFrame:
    """scores(score, actual boolean) -> one row per threshold with its confusion matrix and metrics.

    The grid is a constant array: one pass over the scores whatever its length.
    """
    grid = scores.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    c = grid.groupBy("tau").agg(*M.confusion(F.col("score") >= F.col("tau"), F.col("actual")))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tau", "tp", "fp", "fn", "tn", M.precision(tp, fp).alias("prec"), M.recall(tp, fn).alias("rec"), M.f1(tp, fp, fn).alias("f1"),
        M.balanced_accuracy(tp, fp, fn, tn).alias("bal_acc"), M.mcc(tp, fp, fn, tn).alias("mcc"),
    )


def best_tau(sweep: DataFrame) -> DataFrame:
    """The row of highest F1; the lowest threshold on ties."""
    return sweep.groupBy().agg(F.max_by(F.struct(*sweep.columns), F.struct("f1", -F.col("tau"))).alias("b")).select("b.*")


def score_curve(scores: DataFrame) -> DataFrame:
    """scores(score, actual) -> per distinct score, from the top: tp, fp so far and the totals.

    Equal scores are folded first, and the running sum over distinct scores is taken in two levels.
    """
    per = scores.groupBy("score").agg(F.count_if("actual").alias("p"), F.count("*").alias("n"))
    c = running(per, ["score"], ["p", "n"], down=True)
    pos = per.agg(F.sum("p").alias("pos"))
    return c.join(F.broadcast(pos)).select("score", F.col("p_upto").alias("tp"), (F.col("n_upto") - F.col("p_upto")).alias("fp"), "pos", "p")  # one row


def average_precision(scores: DataFrame) -> DataFrame:
    """Sum over distinct scores of (recall step) x precision."""
    c = score_curve(scores)
    return c.agg(F.sum(T.ratio(F.col("p"), F.col("pos")) * T.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"), F.max("pos").alias("n_pos"))


def best_f1_threshold(scores: DataFrame) -> DataFrame:
    """The exact sweep over all distinct scores: threshold, f1; the highest threshold on ties."""
    c = score_curve(scores).withColumn("f1", M.f1(F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")))
    return c.groupBy().agg(F.max(F.struct("f1", "score")).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


#: Grids of best_f1_on(): how many distinct scores are taken as they are, and the quantiles that stand for more.
GRIDS = {"all_256": (256, 0.0, 1.0, 256), "inner_200": (200, 0.01, 0.99, 200), "rounded_3": None}


def best_f1_on(scores: DataFrame, grid: str) -> DataFrame:
    """threshold, f1: the best F1 of score >= t over the thresholds of a grid; the lowest on ties.

    all_256 and inner_200: the distinct scores, or, where there are more than so many, that
    many linear quantiles of all scores.  rounded_3: distinct scores rounded to three places.
    Scores are counted per value, and each threshold is compared with values, not with rows.
    """
    per = scores.groupBy("score").agg(F.count_if("actual").alias("p"), F.count("*").alias("n"))
    if GRIDS[grid] is None:
        cuts = per.select(F.round("score", 3).alias("t")).distinct()
    else:
        most, low, high, count = GRIDS[grid]
        if per.count() <= most:
            cuts = per.select(F.col("score").alias("t"))
        else:
            cuts = quantiles(per, [low + (high - low) * i / (count - 1) for i in range(count)]).select(F.col("value").alias("t")).distinct()
    # thresholds and values in one order: what stands at or above a threshold is a running sum from the top
    both = per.select(F.col("score").alias("v"), F.lit(1).alias("held"), "p", "n").unionByName(cuts.select(F.col("t").alias("v"), F.lit(0).alias("held"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n")))
    c = running(both, ["v", "held"], ["p", "n"], down=True).where("held = 0")
    pos = per.agg(F.sum("p").alias("pos"))
    c = c.join(F.broadcast(pos)).withColumn("f1", M.f1(F.col("p_upto"), F.col("n_upto") - F.col("p_upto"), F.col("pos") - F.col("p_upto")))  # one row
    return c.groupBy().agg(F.max(F.struct(F.col("f1"), (-F.col("v")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("threshold"), F.col("b.f1").alias("f1"))
