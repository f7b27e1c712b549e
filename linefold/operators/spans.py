"""Containment among nested spans: depths, enclosing spans and parents without a theta join.

Spans of a group are nested or disjoint, as elements, statements and calls are.  Each gives
an event where it opens and one where it closes.  Opens less closes so far, over all events
in one order, is the depth: every group adds up to nothing, so no group needs a task of its
own.  What encloses a span at a lower depth is the last span that opened at that depth
before it; this is looked up inside a part of the sorted events, and what an earlier part
left open comes from one row per part and depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .statistics import in_order, running_in_order


def events(spans: DataFrame) -> DataFrame:
    """spans(grp, id, lo, hi, ...), half-open, lo < hi -> events in order with ``level``, the depth of their span from 0.

    At one place closes come first, then the longest span; of equal spans the smallest id is outside.
    """
    side = lambda pos, open_, tie, own: spans.select("grp", F.col(pos).alias("pos"), F.lit(open_).alias("open"), tie.alias("tie"), own.alias("own"), *[c for c in spans.columns if c != "grp"], F.lit(2 * open_ - 1).cast("bigint").alias("step"))
    both = side("lo", 1, -F.col("hi"), F.col("id")).unionByName(side("hi", 0, -F.col("lo"), -F.col("id")))
    s = running_in_order(in_order(both, ["grp", "pos", "open", "tie", "own"]), ["step"])
    return s.select(*spans.columns, "open", (F.col("step_upto") - F.col("open")).alias("level"), "sort_id", "sort_part")


def _last_opened(asked: DataFrame, opened: DataFrame) -> DataFrame:
    """asked(sort_part, level, sort_id, ...) with ``found``: the last of opened(sort_part, level, sort_id, span) before it at its level."""
    both = asked.withColumn("span", F.lit(None).cast(opened.schema["span"].dataType)).withColumn("asks", F.lit(True))
    both = both.unionByName(opened.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("sort_part", "level").orderBy("sort_id", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("near", F.last("span", ignorenulls=True).over(before)).where("asks")
    # a row per part and level: what the parts so far opened last
    ends = opened.groupBy("sort_part", "level").agg(F.max_by("span", "sort_id").alias("span"))
    ends = ends.unionByName(asked.select("sort_part", "level").distinct(), allowMissingColumns=True).groupBy("sort_part", "level").agg(F.first("span", ignorenulls=True).alias("span"))
    earlier = Window.partitionBy("level").orderBy("sort_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("sort_part").alias("c_part"), F.col("level").alias("c_level"), F.last("span", ignorenulls=True).over(earlier).alias("carried"))
    j = both.join(carried, (F.col("sort_part") == F.col("c_part")) & (F.col("level") == F.col("c_level")))
    return j.withColumn("found", F.coalesce("near", "carried")).drop("span", "asks", "near", "carried", "c_part", "c_level")


def depths(spans: DataFrame) -> DataFrame:
    """(grp, id, depth): how many spans enclose each."""
    return events(spans).where("open = 1").select("grp", "id", F.col("level").alias("depth"))


def enclosing(spans: DataFrame, parents_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(grp, id, depth, around, around_depth): every span with each span that encloses it, or with its parent only.

    carry: columns of spans that come along from the enclosing one, as around_<column>.
    Spans at the top have no rows.  The rows of a span are as many as its depth, which is
    the size of the result; spans must be laminar, see crossing().
    """
    e = materialize(events(spans).where("open = 1"), "span-events")
    opened = e.select("sort_part", "level", "sort_id", F.struct("id", *carry).alias("span"))
    levels = F.array(F.col("level") - 1) if parents_only else F.sequence(F.lit(0).cast("bigint"), F.col("level") - 1)
    asked = e.where("level > 0").select("grp", "id", F.col("level").alias("depth"), "sort_part", "sort_id", F.explode(levels).alias("level"))
    return _last_opened(asked, opened).select("grp", "id", "depth", F.col("found.id").alias("around"), F.col("level").alias("around_depth"), *[F.col(f"found.{c}").alias(f"around_{c}") for c in carry])


def crossing(spans: DataFrame) -> DataFrame:
    """(grp, id) of spans that close while a span which opened later is still open: none where spans are laminar."""
    e = materialize(events(spans), "span-events")
    opened = e.where("open = 1").select("sort_part", "level", "sort_id", F.struct("grp", "id").alias("span"))
    closes = e.where("open = 0").select("grp", "id", "sort_part", "sort_id", "level")
    return _last_opened(closes, opened).where(~F.struct("grp", "id").eqNullSafe(F.col("found"))).select("grp", "id")
