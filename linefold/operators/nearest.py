"""The nearest signature of every query, without all pairs: by shared features, or by angle.

By features: those of a set stand in order of rarity among the signatures.  A signature of n
features that scores at least t shares one of its first n - t n + 1, so each posting knows
the highest t at which it is needed, and hot features, which stand last, are needed only
by queries that find nothing better.  A first round over the smallest holders of a query's
rarest features gives each query a bound of its own; the second meets the postings that
this bound needs, and compares what is left as whole sets.

By angle: angles to a few pivots bound the angle between two vectors (triangle inequality).
Vectors stand in blocks by pivot and angle; a query visits the blocks that its bound reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship

# -- by shared features -----------------------------------------------------------------------------------------

#: The first round: so many of a query's rarest features, so many of the smallest holders of each.
RAREST, SMALLEST = 6, 4


def _level(t: Column) -> Column:
    """Classes of thresholds, a factor of the square root of two each, from 0 at one upwards."""
    return F.greatest(F.lit(0), F.floor(-2 * F.log2(t) + 1e-9)).cast("int")


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("q").agg(F.max(F.struct("score", (-F.col("s")).alias("m"))).alias("b")).select("q", (-F.col("b.m")).alias("s"), F.col("b.score").alias("score"))


def by_overlap(queries: DataFrame, signatures: DataFrame, jaccard: bool = False) -> DataFrame:
    """queries(q, feats), signatures(s, feats), distinct features in arrays -> (q, s, score): the best signature of each query.

    score: shared features over those of the signature, or over those of either (jaccard).
    The smallest s wins ties; a query that shares nothing gets (null, 0); queries and
    signatures without features are left out.  Ids are unique and not null.
    """
    ask = materialize(queries.select("q", F.col("feats").alias("qf")).where(F.size("qf") > 0), "nearest-queries")
    sig = materialize(signatures.select("s", F.col("feats").alias("sf")).where(F.size("sf") > 0), "nearest-signatures")
    ns, nq = F.size("sf").cast("bigint"), F.size("qf").cast("bigint")
    each = sig.select("s", ns.alias("ns"), F.explode("sf").alias("feat"))
    held = each.groupBy("feat").agg(F.count("*").alias("df"))
    rank = lambda by: (F.row_number().over(Window.partitionBy(by).orderBy("df", "feat")) - 1).cast("bigint")
    # a posting at place p is in the prefix of every threshold up to (ns - p) / ns
    post = each.join(held, "feat").withColumn("ps", rank("s")).select("feat", "s", "ns", "ps", _level((F.col("ns") - F.col("ps")) / F.col("ns")).alias("level"))
    post = materialize(post, "nearest-postings")
    own = ask.select("q", nq.alias("nq"), F.explode("qf").alias("feat")).join(held, "feat", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    own = materialize(own.withColumn("pq", rank("q")).withColumn("known", F.count_if(F.col("df") > 0).over(Window.partitionBy("q"))).where("df > 0"), "nearest-features")

    def compared(pairs: DataFrame) -> DataFrame:
        j = pairs.join(ask, "q").join(sig, "s").withColumn("c", F.size(F.array_intersect("qf", "sf")).cast("bigint"))
        return j.select("q", "s", (F.col("c") / (nq + ns - F.col("c") if jaccard else ns)).alias("score"))

    smallest = post.withColumn("k", F.row_number().over(Window.partitionBy("feat").orderBy("ns", "s"))).where(F.col("k") <= SMALLEST)
    rarest = own.where(F.col("pq") - (F.col("nq") - F.col("known")) < RAREST)
    bound = materialize(compared(rarest.join(smallest, "feat").select("q", "s").distinct()).groupBy("q").agg((F.max("score") - 1e-12).alias("t")), "nearest-bounds")
    asked = own.join(bound, "q")
    if jaccard:
        asked = asked.where(F.col("pq") <= F.col("nq") - F.ceil(F.col("t") * F.col("nq")))
    asked = asked.select("q", "nq", "feat", "pq", "t", F.explode(F.sequence(F.lit(0), _level(F.col("t")))).alias("level"))
    # the shared features stand behind both places: no pair can share more than that
    most = F.least(F.col("nq") - F.col("pq"), F.col("ns") - F.col("ps"))
    reach = most / (F.col("nq") + F.col("ns") - most if jaccard else F.col("ns"))
    pairs = asked.join(post, ["feat", "level"]).where(reach >= F.col("t")).select("q", "s").distinct()
    found = _best(compared(pairs))
    return ask.select("q").join(found, "q", "left").select("q", "s", F.coalesce("score", F.lit(0.0)).alias("score"))


# -- by angle -----------------------------------------------------------------------------------------------------

PIVOTS, RINGS, SAMPLE_ROWS, BLOCK_ROWS = 16, 64, 2048, 4096
SLACK = 1e-6


def unit(cells: pa.Array) -> np.ndarray:
    m = np.array(cells.to_pylist(), float)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """k of the rows, each the farthest from those before it."""
    chosen = [0]
    far = angles(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def by_angle(queries: DataFrame, base: DataFrame) -> DataFrame:
    """queries(q, v), base(s, v) -> (q, s, score, compared): the nearest other vector by cosine, and how many were looked at.

    Cosines count to nine places, the smallest s wins ties; a vector of length 0 has cosine
    0 with all.  Ids are unique; null vectors are left out; a query without any other vector
    has no row.
    """
    spark = queries.sparkSession
    ship(spark)
    vectors = lambda df, k: df.select(F.col(k).cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    every, asked = vectors(base, "s"), vectors(queries, "q")
    h = F.xxhash64("id")
    some = every.where(length > 0).orderBy(h, "id").limit(SAMPLE_ROWS).select("v").toPandas()  # a bounded sample
    flat = every.where(length == 0).orderBy("id").limit(2).collect()  # equal at 0 with all: the two smallest stand for them
    least = every.orderBy("id").limit(2).collect()
    zero = (asked.where(length == 0) if len(some) else asked).select(F.col("id").alias("q"), F.explode(F.array(*[F.lit(r["id"]) for r in least]).cast("array<bigint>")).alias("s")).where("q <> s")
    zero = zero.groupBy("q").agg(F.min("s").alias("s")).select("q", "s", F.lit(0.0).alias("score"), F.lit(len(least)).cast("bigint").alias("compared"))
    if not len(some):
        return zero
    pivots = spread_out(unit(pa.array(some["v"].tolist())), PIVOTS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(b.column(1))
            a = angles(x, pivots)
            cell = a.argmin(axis=1)
            ring = np.minimum(RINGS - 1, (a[np.arange(len(a)), cell] * RINGS / np.pi).astype(np.int64))
            cells = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), cells(x), cells(a), pa.array(cell * RINGS + ring)], names=["id", "x", "a", "block"])

    schema = "id bigint, x binary, a binary, block bigint"
    rows = materialize(every.where(length > 0).mapInArrow(place, schema), "angle-rows")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            a, block = np.frombuffer(b"".join(b.column(0).to_pylist())).reshape(b.num_rows, -1), b.column(1).to_numpy()
            for k in np.unique(block):
                own = a[block == k]
                k = int(k)
                low[k] = np.minimum(low[k], own.min(axis=0)) if k in low else own.min(axis=0)
                high[k] = np.maximum(high[k], own.max(axis=0)) if k in high else own.max(axis=0)
                n[k] = n.get(k, 0) + len(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([v.tolist() for v in low.values()], pa.list_(pa.float64())), pa.array([v.tolist() for v in high.values()], pa.list_(pa.float64())), pa.array(list(n.values()), pa.int64())], names=["block", "low", "high", "n"])

    per = rows.select("a", "block").mapInArrow(measured, "block bigint, low array<double>, high array<double>, n bigint")
    ends = lambda c, f: F.array(*[f(F.col(c)[i]) for i in range(len(pivots))]).alias(c)
    stats = per.groupBy("block").agg(ends("low", F.min), ends("high", F.max), F.sum("n").alias("n")).orderBy("block").collect()  # at most PIVOTS * RINGS rows
    blocks, low, high = (np.array([r[c] for r in stats]) for c in ("block", "low", "high"))
    salts = np.array([-(-r["n"] // BLOCK_ROWS) for r in stats])
    dealt = F.broadcast(spark.createDataFrame([(int(b), int(k)) for b, k in zip(blocks, salts, strict=True)], "at bigint, salts bigint"))  # a row per block
    rows = rows.join(dealt, F.col("block") == F.col("at")).select("block", F.pmod(F.xxhash64("id"), "salts").alias("salt"), "id", "x")
    ask = materialize(asked.where(length > 0).mapInArrow(place, schema).select("id", "x", "a", F.lit(math.pi).alias("reach")), "angle-queries")

    def planned(df: DataFrame, seed: bool) -> DataFrame:
        """The blocks that each query visits: the nearest one, or all within its reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                a = np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(b.num_rows, -1)
                for i in range(b.num_rows):
                    far = np.maximum(low - a[i], a[i] - high).max(axis=1)
                    if seed:
                        visit, salt = np.array([far.argmin()]), np.array([0])
                    else:
                        near = np.flatnonzero(far <= b.column(3)[i].as_py() + SLACK)
                        visit = np.repeat(near, salts[near])
                        salt = np.arange(len(visit)) - np.repeat(np.cumsum(salts[near]) - salts[near], salts[near])
                    same = lambda c: pa.array([b.column(c)[i].as_py()] * len(visit), b.column(c).type)
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[visit]), pa.array(salt.astype(np.int64)), same(0), same(1)], names=["block", "salt", "id", "x"])

        return df.mapInArrow(run, "block bigint, salt bigint, id bigint, x binary")

    def met(df: DataFrame) -> DataFrame:
        """(q, s, score, compared) per query and block that it visits: a block's vectors come first, then its queries."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, held, block = None, [], [], None
            for b in batches:
                key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)] if len(key) else [0]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if at != tuple(key[lo, :2]):
                        at, ids, held, block = tuple(key[lo, :2]), [], [], None
                    x = b"".join(b.column(4).slice(lo, hi - lo).to_pylist())
                    own = b.column(3).slice(lo, hi - lo).to_numpy()
                    if key[lo, 2] == 0:
                        ids.append(own)
                        held.append(x)
                        continue
                    if not held:
                        continue
                    if block is None:
                        s = np.concatenate(ids)
                        order = np.argsort(s)
                        block = s[order], np.frombuffer(b"".join(held)).reshape(len(s), -1)[order]
                    s, m = block
                    sim = np.round(np.frombuffer(x).reshape(len(own), -1) @ m.T, 9)
                    sim[own[:, None] == s[None, :]] = -2
                    best = sim.argmax(axis=1)
                    top = sim[np.arange(len(own)), best]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(s[best]), pa.array(top), pa.array(np.full(len(own), len(s)))], names=["q", "s", "score", "compared"]).filter(pa.array(top > -2))

        kind = lambda d, k: d.select("block", "salt", F.lit(k).alias("kind"), "id", "x")
        both = kind(rows, 0).unionByName(kind(df, 1)).repartition(min(20_000, max(1, int(salts.sum()))), "block", "salt").sortWithinPartitions("block", "salt", "kind")
        out = both.mapInArrow(run, "q bigint, s bigint, score double, compared bigint")
        for r in flat:
            out = out.unionByName(df.select(F.col("id").alias("q")).where(F.col("q") != r["id"]).distinct().select("q", F.lit(r["id"]).cast("bigint").alias("s"), F.lit(0.0).alias("score"), F.lit(1).cast("bigint").alias("compared")))
        return out.groupBy("q").agg(F.max(F.struct("score", (-F.col("s")).alias("m"))).alias("b"), F.sum("compared").alias("compared")).select("q", (-F.col("b.m")).alias("s"), F.col("b.score").alias("score"), "compared")

    seeds = met(planned(ask, True)).select("q", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") - 2e-9))).alias("own"))
    reach = ask.join(seeds, F.col("id") == F.col("q"), "left").select("id", "x", "a", F.coalesce("own", "reach").alias("reach"))
    return met(planned(reach, False)).unionByName(zero)
