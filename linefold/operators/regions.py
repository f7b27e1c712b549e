"""Line regions: lines, copies to compare, mention regions, windows, orders.

Long form throughout: a region is a set of rows (id, line_idx).  All of it is keyed by the
document id, so one shuffle by id serves a chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_idx, line), 0-based."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.lines(F.col(text_col))).alias("line_idx", "line")).withColumn("line_idx", F.col("line_idx").cast("bigint"))


def copy_pairs(docs: DataFrame, min_length: int = 20, min_shared: int = 2) -> DataFrame:
    """(x, y): each document with the next one that shares enough long lines and differs.

    A line pairs a document with the next holder of that line only, so a line that every
    document has gives as many rows as documents, not as many as pairs.
    """
    lines = explode_lines(docs).where(F.length("line") > min_length).select("doc_id", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")).distinct()
    both = next_holder(lines).groupBy(F.col("doc_id").alias("x"), "y").agg(F.count("*").alias("n")).where(F.col("n") >= min_shared)
    digests = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("t"))
    differ = both.join(digests.select(F.col("doc_id").alias("x"), F.col("t").alias("tx")), "x").join(digests.select(F.col("doc_id").alias("y"), F.col("t").alias("ty")), "y").where("tx <> ty")
    return differ.groupBy("x").agg(F.min("y").alias("y"))


def next_holder(holders: DataFrame, span: int = 4096) -> DataFrame:
    """holders(doc_id, key), distinct -> (doc_id, y): the next larger id with the same key, per key.

    In two levels, ranges of ids and then the ranges' ends, so that a key that many
    documents hold is dealt over many tasks.
    """
    h = holders.withColumn("cell", F.floor(F.col("doc_id") / span))
    inside = h.select("doc_id", F.lead("doc_id").over(Window.partitionBy("key", "cell").orderBy("doc_id")).alias("y"))
    ends = h.groupBy("key", "cell").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    across = ends.select(F.col("last").alias("doc_id"), F.lead("first").over(Window.partitionBy("key").orderBy("cell")).alias("y"))
    return inside.unionByName(across).where("y is not null")


def deleted_lines(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, line_idx) of lines of x whose text y does not have: an anti join."""
    before = lines.join(pairs, lines["doc_id"] == pairs["x"]).select("doc_id", "y", "line_idx", "line")
    after = lines.select(F.col("doc_id").alias("y"), "line").distinct()
    return before.join(after, ["y", "line"], "left_anti").select("doc_id", "line_idx")


def multiset_diff(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, line, n_before, n_after, n_deleted, n_added) of lines whose counts differ."""
    counts = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    a = counts.join(pairs, counts["doc_id"] == pairs["x"]).select("x", "y", "line", F.col("n").alias("n_before"), F.lit(0).cast("bigint").alias("n_after"))
    b = counts.join(pairs, counts["doc_id"] == pairs["y"]).select("x", "y", "line", F.lit(0).cast("bigint").alias("n_before"), F.col("n").alias("n_after"))
    both = a.unionByName(b).groupBy("x", "y", "line").agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after")).where("n_before <> n_after")
    return both.withColumn("n_deleted", F.greatest(F.lit(0), F.col("n_before") - F.col("n_after"))).withColumn("n_added", F.greatest(F.lit(0), F.col("n_after") - F.col("n_before")))


def mention_region(lines: DataFrame, criterion: Column, min_length: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line_idx) of lines that share an identifier with a criterion line of the document.

    A semi join of tokens, keyed by document and token.
    """
    toks = lines.select("doc_id", "line_idx", criterion.alias("crit"), F.explode(F.array_distinct(T.idents(F.col("line")))).alias("tok")).where(F.length("tok") >= min_length)
    if stop:
        toks = toks.where(~F.col("tok").isin(*stop))
    seeds = toks.where("crit").select("doc_id", "tok").distinct()
    return toks.join(seeds, ["doc_id", "tok"], "left_semi").select("doc_id", "line_idx").distinct()


def nearest_sink(lines: DataFrame, sink: Column) -> DataFrame:
    """lines with ``dist`` to the nearest sink line; the number of lines where there is none.

    Two ordered windows instead of a join of sinks and lines.
    """
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    at = F.when(sink, F.col("line_idx"))
    back = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return lines.withColumn("n_lines", n).withColumn("dist", F.coalesce(F.least(F.col("line_idx") - back, ahead - F.col("line_idx")), F.col("n_lines")))


def window_region(lines: DataFrame, sink: Column, k: int) -> DataFrame:
    """Lines within k of a sink."""
    near = nearest_sink(lines, sink)
    return near.where((F.col("dist") <= k) & (F.col("dist") < F.col("n_lines"))).select("doc_id", "line_idx")


def calibrated_window(lines: DataFrame, sink: Column, sizes: DataFrame, start: int = 1) -> DataFrame:
    """(doc_id, n_lines, target, k, win_size): the smallest k >= start whose window has at least target lines.

    sizes: (doc_id, target).  Distances are counted and summed up once for all k.
    """
    near = nearest_sink(lines, sink).where(F.col("dist") < F.col("n_lines")).withColumn("k", F.greatest(F.col("dist"), F.lit(start)))
    per = near.groupBy("doc_id", "n_lines", "k").agg(F.count("*").alias("c"))
    size = F.sum("c").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("win_size", size).join(sizes, "doc_id")
    return per.where("win_size >= target").groupBy("doc_id", "n_lines", "target").agg(F.min(F.struct("k", "win_size")).alias("b")).select("doc_id", "n_lines", "target", "b.k", "b.win_size")


def unit_mapping(region: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, unit) of units(doc_id, unit, lo, hi) that a region's line falls in: an interval join within the document."""
    return region.join(units, "doc_id").where(F.col("line_idx").between(F.col("lo"), F.col("hi"))).select("doc_id", "unit").distinct()


def reading_order(lines: DataFrame, kind: str) -> DataFrame:
    """lines(doc_id, line_idx, in_region, dist) with ``pos``, the 0-based place in a reading order.

    kinds: top_down, region_first, sink_proximity (region by distance, then the rest).
    """
    keys = {
        "top_down": [F.col("line_idx")],
        "region_first": [F.col("in_region").desc(), F.col("line_idx")],
        "sink_proximity": [F.col("in_region").desc(), F.when(F.col("in_region"), F.col("dist")), F.col("line_idx")],
    }[kind]
    return lines.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)) - 1).cast("bigint"))


def effort(ordered: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per document: n_lines, ifa (place of the first hit), effort ((last + 1) / n) and top-k flags."""
    n = ordered.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    at = ordered.join(hits, ["doc_id", "line_idx"], "left_semi").groupBy("doc_id").agg(F.min("pos").alias("ifa"), F.max("pos").alias("last"), F.count("*").alias("n_hits"))
    out = at.join(n, "doc_id").withColumn("effort", (F.col("last") + 1) / F.col("n_lines"))
    for k in ks:
        out = out.withColumn(f"top{k}", (F.col("ifa") < k).cast("bigint"))
    return out.drop("last")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(grp, node, depth): nodes reachable from seeds(grp, node) along edges(grp, src, dst), with least hops.

    Semi-naive: each step joins only what the last one found, until nothing is new.  Steps
    are appended to one table in the shared folder, which is what the next step reads, so
    neither the plan nor the writing grows with the depth.
    """
    from ..runtime import append, new_path

    path = new_path(edges.sparkSession, "closure")
    front = append(seeds.select("grp", "node").distinct().withColumn("depth", F.lit(0).cast("bigint")), path)
    depth = 0
    while not front.isEmpty():
        depth += 1
        found = edges.sparkSession.read.schema(front.schema).parquet(path)
        step = front.join(edges, (front["grp"] == edges["grp"]) & (front["node"] == edges["src"])).select(front["grp"], F.col("dst").alias("node")).distinct()
        append(step.join(found, ["grp", "node"], "left_anti").select("grp", "node", F.lit(depth).cast("bigint").alias("depth")), path)
        front = edges.sparkSession.read.schema(front.schema).parquet(path).where(F.col("depth") == depth)
    return edges.sparkSession.read.schema(front.schema).parquet(path)


def token_region(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, line_idx) of lines that mention one of tokens(doc_id, tok): the text-scan region of fix variables."""
    toks = lines.select("doc_id", "line_idx", F.explode(F.array_distinct(T.idents(F.col("line")))).alias("tok"))
    return toks.join(tokens.select("doc_id", "tok").distinct(), ["doc_id", "tok"], "left_semi").select("doc_id", "line_idx").distinct()


def changed_identifiers(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, tok) of x: identifiers on lines that only one side of the pair has; all of x's where there is none."""
    swapped = pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))
    own = deleted_lines(lines, pairs).join(lines, ["doc_id", "line_idx"]).select("doc_id", "line")
    after = lines.join(swapped, lines["doc_id"] == swapped["x"]).select(F.col("y").alias("doc_id"), "line")
    before = lines.select("doc_id", "line").distinct()
    added = after.join(before, ["doc_id", "line"], "left_anti")
    ids = lambda df: df.select("doc_id", F.explode(T.idents(F.col("line"))).alias("tok")).distinct()
    changed = ids(own.unionByName(added)).distinct()
    none = pairs.select(F.col("x").alias("doc_id")).join(changed.select("doc_id").distinct(), "doc_id", "left_anti")
    return changed.unionByName(ids(lines.join(none, "doc_id", "left_semi")))


def graph_slice(nodes: DataFrame, edges: DataFrame, seed_kinds: tuple[str, ...] = ("call",), follow: tuple[str, ...] = ("reaching", "controls", "child"), drop: tuple[str, ...] = ("parameter", "method")) -> DataFrame:
    """(grp, node, line, depth): what seed nodes reach in a program graph, without nodes of the dropped kinds.

    nodes(grp, node, line, kind), edges(grp, src, dst, kind), a graph per grp: the slice that
    an external analyser's graph gives, as a fixed point over the followed kinds of edges.
    """
    seeds = nodes.where(F.col("kind").isin(*seed_kinds)).select("grp", "node")
    found = closure(edges.where(F.col("kind").isin(*follow)).select("grp", "src", "dst"), seeds)
    kept = nodes.where(~F.col("kind").isin(*drop)).select("grp", "node", "line")
    return found.join(kept, ["grp", "node"]).select("grp", "node", "line", "depth")
