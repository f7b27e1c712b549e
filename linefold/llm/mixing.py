"""Mixing sources to target weights by weighted fair queueing, native DataFrame operations only.

Each source serves its shuffled documents, pass after pass, at a rate in proportion to its
target.  A copy of a document has a virtual finish time: the words that its source has
served when it is done, divided by the source's target in whole words.  The copies of all
sources are range-sorted by finish time, summed up, and cut at the total budget; what the
cut queue holds of a document is what the mix takes of it.  All sources reach their targets
at virtual time 1, and a copy on its way at that time counts as two pieces, so the cut falls
between pieces and gives each source its target.

Running sums are taken in levels: inside a source, cells of the shuffle key and then offsets
of cells; along the queue, chunks of the sorted table and then their offsets, and rows only
in the one chunk that the cut falls into.  So neither a source with a third of all rows nor
the queue meets in one task.

Defined cases: null text has size 0; a null source is a source of its own, sorted last;
rows that are equal in every column are interchangeable; an empty table gives no rows; a
source of size 0 has target 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

WEIGHTS = (5, 2, 1)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source (src_key, total): weight and target.

    Sources that would pass ``most`` times their size stop there; what they leave goes to
    the others by weight until none is above.  That is the water level at which
    min(most * size, level * weight) sums to the total, found by one pass in the order of
    most * size / weight.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(everything.orderBy("src_key")) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("total").cast("double") * most)
    order = everything.orderBy((F.col("cap") / F.col("w")), "src_key")
    ranked = (
        ranked.withColumn("all", F.sum("total").over(everything).cast("double"))
        .withColumn("cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("w_rest", F.sum("w").over(everything) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("w"))
        .withColumn("level", (F.col("all") - F.col("cap_before")) / F.col("w_rest"))
        .withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
        .withColumn("water", F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("src_key").alias("k"), F.col("level").alias("level")))).over(everything)["level"])
    )
    return ranked.select("src_key", F.col("total").alias("source_size"), F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def shuffled(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix", cells: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents in the order of their sources, sources): the first with row, doc_id, size, source_size, target, budget, before.

    budget: whole words of the target.  before: words of its source ahead of it in one pass.
    cells: hex digits of the shuffle key that make a cell.
    """
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "size",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("src_key"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("shuffle_key"),
    ).withColumn("cell", F.substring("shuffle_key", 1, cells))
    rows = materialize(rows, "mix-sizes")
    by_cell = rows.groupBy("src_key", "cell").agg(F.sum("size").alias("cell_size"))
    sources = targets(by_cell.groupBy("src_key").agg(F.sum("cell_size").alias("total")), weights, most)
    sources = materialize(sources.withColumn("budget", F.floor(F.round("target", 6)).cast("bigint")), "mix-sources")
    upto = Window.partitionBy("src_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = by_cell.withColumn("offset", F.sum("cell_size").over(upto) - F.col("cell_size")).join(sources, "src_key").select("src_key", "cell", "offset", "source_size", "target", "budget")
    inside = Window.partitionBy("src_key", "cell").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["src_key", "cell"]).withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))
    return placed.select("row", "doc_id", "size", "source_size", "target", "budget", "before"), sources


def queue(placed: DataFrame) -> DataFrame:
    """The range-sorted queue: a row per piece of a copy, with words, finish and place, which grows along it.

    A source sends as many copies as its target may need; what the cut leaves is not known here.
    """
    copies = F.greatest(F.lit(1), F.ceil(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).cast("int"))
    q = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1)))
    start, budget = F.col("before") + F.col("copy") * F.col("source_size"), F.col("budget")
    end = start + F.col("size")
    piece = lambda words, upto: F.struct(words.alias("words"), upto.alias("upto"))
    q = q.withColumn("p", F.explode(F.when((start < budget) & (end > budget), F.array(piece(budget - start, budget), piece(end - budget, end))).otherwise(F.array(piece(F.col("size"), end)))))
    upto = F.col("p.upto")
    finish = F.when(upto == 0, 0.0).otherwise(F.coalesce(upto / F.nullif(budget, F.lit(0)), F.lit(float("inf"))))
    q = q.select("row", "doc_id", "size", "source_size", "target", "before", "copy", F.col("p.words").alias("words"), upto.alias("upto"), finish.alias("finish"))
    return materialize(q.orderBy("finish", "row", "copy", "upto").withColumn("place", F.monotonically_increasing_id()), "mix-queue")


def cut(q: DataFrame, budget: int, chunk_bits: int = 12) -> DataFrame:
    """The queue with ``take``: its words up to the budget, along the queue."""
    chunk = F.shiftright("place", chunk_bits)
    chunks = q.groupBy(chunk.alias("chunk")).agg(F.sum("words").alias("n"))
    # places of one partition of the sort share their bits from the 33rd on
    chunks = chunks.withColumn("part", F.shiftright("chunk", 33 - chunk_bits))
    upto = lambda w, order: F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("part").alias("own"), upto(Window.partitionBy(F.lit(0)), "part").alias("offset"))
    ahead = chunks.withColumn("inside", upto(Window.partitionBy("part"), "chunk")).join(parts, F.col("part") == F.col("own")).withColumn("ahead", F.col("offset") + F.col("inside"))
    # one row: the chunk in which the budget runs out
    at = ahead.where(F.col("ahead") + F.col("n") >= budget).agg(F.min(F.struct("chunk", "ahead")).alias("b")).collect()[0]["b"]
    if at is None:
        return q.withColumn("take", F.col("words"))
    # at most 2 ** chunk_bits rows
    rows = q.where((F.col("place") >= at["chunk"] << chunk_bits) & (F.col("place") < (at["chunk"] + 1) << chunk_bits)).select("place", F.col("words").alias("n"))
    rows = rows.withColumn("ahead", upto(Window.partitionBy(F.lit(0)), "place") + at["ahead"])
    last = rows.where(F.col("ahead") + F.col("n") >= budget).agg(F.min(F.struct("place", (F.lit(budget) - F.col("ahead")).alias("left"))).alias("b")).collect()[0]["b"]
    return q.withColumn("take", F.when(F.col("place") < last["place"], F.col("words")).when(F.col("place") == last["place"], F.lit(last["left"])).otherwise(F.lit(0)).cast("bigint"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix", cells: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, takes (by copy) and before, from the cut queue."""
    placed, sources = shuffled(docs, weights, most, seed, cells)
    budget = sources.agg(F.coalesce(F.sum("budget"), F.lit(0))).collect()[0][0]
    q = cut(queue(placed), budget)
    takes = [F.coalesce(F.sum(F.when(F.col("copy") == e, F.col("take"))), F.lit(0)).cast("bigint").alias(f"t{e}") for e in range(most)]
    own = ("doc_id", "size", "source_size", "target", "before")
    per = q.groupBy("row").agg(*[F.first(c).alias(c) for c in own], F.sum("take").alias("taken"), *takes)
    return per.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", F.array(*[f"t{e}" for e in range(most)]).alias("takes"), "before")


def schedule(mixed: DataFrame) -> DataFrame:
    """The queue itself: a row per copy in the mix, range-sorted by virtual finish time."""
    copies = mixed.select("doc_id", "size", "source_size", "target", "before", F.posexplode("takes").alias("copy", "take")).where("take > 0")
    finish = (F.col("before") + F.col("copy") * F.col("source_size") + F.col("size")) / F.col("target")
    return copies.select("doc_id", F.col("copy").cast("bigint").alias("copy"), "take", finish.alias("finish")).orderBy("finish", "doc_id", "copy")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT src_key, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY 1),
r AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY src_key) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w, total * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(total) OVER ()::DOUBLE - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
      FROM r WINDOW o AS (ORDER BY cap / w, src_key ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap / w <= level AS capped FROM l),
t AS (SELECT src_key, total, CASE WHEN capped THEN cap ELSE w * (SELECT min(level) FROM (SELECT level FROM c WHERE NOT capped ORDER BY cap / w, src_key LIMIT 1)) END AS target FROM c),
p AS (SELECT doc_id, d.size, total, target, CAST(floor(round(target, 6)) AS BIGINT) AS budget,
             CAST(sum(d.size) OVER (PARTITION BY d.src_key ORDER BY k, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
      FROM d JOIN t USING (src_key))
SELECT doc_id, size, total AS source_size, target,
       greatest(0, least(size, budget - before)) + greatest(0, least(size, budget - before - total)) + greatest(0, least(size, budget - before - 2 * total)) AS taken
FROM p
"""
