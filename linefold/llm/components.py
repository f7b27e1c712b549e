"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize_at


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of bigint -> (node, root), root the smallest node reachable; nodes without an edge to another are left out.

    Each round joins neighbours to the smallest node around them.  Sums and minima per
    node are pre-aggregated, and joins on a hub's id are plain equi-joins, which adaptive
    execution splits.  Rounds are written to the shared folder, so lineage stays short; they
    go on, about log n of them, until the edges are stars, which a further round would leave
    alone: so none is spent on seeing that nothing changes.  Every round costs the driver
    plans, and tasks that it remembers.
    """
    spark = edges.sparkSession
    first = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    # a small star first folds nodes with many edges below them, before any edge is turned round
    cur, path = materialize_at(_small_star(first), "cc")
    while not _are_stars(cur):
        nxt, nxt_path = materialize_at(_small_star(_large_star(cur)), "cc")
        discard(spark, path)
        cur, path = nxt, nxt_path
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def components_of(graphs: list[DataFrame]) -> list[DataFrame]:
    """connected_components() of several graphs in the same rounds; nodes are from 0 to below 2^63 / len(graphs), as their order is kept."""
    n = len(graphs)
    edges = [g.select((F.col("a") * n + i).alias("a"), (F.col("b") * n + i).alias("b")) for i, g in enumerate(graphs)]
    found = connected_components(reduce(DataFrame.unionByName, edges))
    return [found.where(F.col("node") % n == i).selectExpr(f"node div {n} AS node", f"root div {n} AS root") for i in range(n)]


def _are_stars(cur: DataFrame) -> bool:
    """Whether every node above another has one edge down, to a node that has none itself; cur is distinct, with b < a."""
    ends = cur.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("below"))
    ends = ends.unionByName(cur.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("below")))
    odd = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("below").alias("below")).where("down > 1 or (down = 1 and below = 1)")
    return odd.agg(F.count("*")).collect()[0][0] == 0


def _large_star(cur: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the smallest node around it."""
    both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(low, both["a"] == low["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(cur: DataFrame) -> DataFrame:
    """Neighbours below a node, and itself, go to the smallest of them."""
    least = cur.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    small = cur.join(least, cur["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
