"""Line graphs: sequential, shared-identifier and control edges, normalisation, propagation.

A document's graph is an array in its row, so nothing is shuffled and nothing joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often, and in whatever lambda, body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def later(text: Column, header: Callable[[Column], Column], max_nodes: int = 80, ahead: int = 3) -> Column:
    """The graph of a text's first max_nodes lines: for each line the later ones that it has edges to.

    Sequential neighbours, lines that share an identifier, and header lines with the next
    ``ahead``.  max_nodes is the graph's defined size; it also bounds the shared edges.
    """

    def edges(nodes: Column) -> Column:
        told = F.transform(nodes, lambda line: F.struct(F.array_distinct(T.idents(line)).alias("toks"), header(line).alias("head")))
        return let(told, lambda t: F.transform(t, lambda x, i: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda j: (j > i) & ((j == i + 1) | (x["head"] & (j <= i + ahead)) | F.arrays_overlap(x["toks"], F.get(t, j)["toks"])))))

    return F.when(F.size(T.lines(text)) > 0, let(F.slice(T.lines(text), 1, max_nodes), edges)).otherwise(F.array().cast("array<array<int>>"))


def around(later_nodes: Column) -> Column:
    """Both directions and loops: for each node all that it has an edge with, and itself."""

    def near(up: Column) -> Column:
        return F.transform(up, lambda own, i: F.concat(F.filter(F.sequence(F.lit(0), i), lambda j: (j == i) | F.array_contains(F.get(up, j), i)), own))

    return let(later_nodes, near)


def weights(near: Column) -> Column:
    """For each node the normalised weights of around(), in its order: 1 / sqrt(d_a d_b)."""
    return let(F.transform(near, lambda n: F.size(n).cast("double")), lambda d: F.transform(near, lambda n, i: F.transform(n, lambda j: 1 / F.sqrt(F.get(d, i) * F.get(d, j)))))


def spread(near: Column, x: Column) -> Column:
    """One step of propagation: for each node the weighted sum of x over around()."""
    return let(F.struct(near.alias("n"), x.alias("x")), lambda s: F.zip_with(s["n"], weights(s["n"]), lambda n, w: F.aggregate(F.zip_with(n, w, lambda j, v: v * F.get(s["x"], j)), F.lit(0.0), lambda a, y: a + y)))


def line_graph(docs: DataFrame, header: Callable[[Column], Column], max_nodes: int = 80, ahead: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, a, b), a < b: the edges of every document's graph as rows."""
    up = docs.select("doc_id", F.posexplode(later(F.col("text"), header, max_nodes, ahead)).alias("a", "up"))
    return up.select("doc_id", F.col("a").cast("bigint").alias("a"), F.explode(F.col("up").cast("array<bigint>")).alias("b"))
