"""Hard negatives for embeddings: a dual-tree search, exact.

A top tree is fitted on a bounded sample and every row is routed to one of its cells; balls
around the rows of each node, and their labels, are measured on all rows.  Anchors stand in
groups of one cell and label.  Interval arithmetic on two balls bounds the inner products of
a group with a node: a node whose interval cannot reach what the group still needs is pruned
for all its anchors at once.  What is left of a cell meets its blocks of bounded size; each
block goes on with trees of its own and of the group, and scores pairs of leaves exactly.

Four rounds of one function: seeds for the positives (a block of the own cell), positives,
seeds for the negatives, negatives.  A seed only raises the bar; the round after it is complete.

Equal vectors of one label tie with every anchor, so they are one candidate with its smallest
ids, as many as any result can hold, and equal anchors are searched once.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take
no part; of rows with one id, the first by label and vector counts, so repeated rows count
once; shorter vectors count as padded with zeros; an anchor without positives, or without
negatives, has no rows; an empty table gives an empty result; extra columns are ignored.
Scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship

FAR = 1 << 62
#: Rows of the sample that the top tree is fitted on, and its cells at most.
SAMPLE_ROWS, MAX_CELLS = 16_384, 1024
GROUP, LEAF_ANCHORS, LEAF_ROWS = 64, 32, 512


# ---- trees of balls


@dataclass
class Ball:
    """Rows (places in a matrix) inside a ball, with the labels that they have."""

    rows: np.ndarray
    center: np.ndarray
    radius: float
    norm: float
    low: int
    high: int
    parts: tuple[Ball, ...] = ()


def direction(x: np.ndarray) -> np.ndarray:
    """About the direction of largest spread, by a few power steps from the farthest row."""
    d = x - x.mean(axis=0)
    u = d[int(np.argmax((d * d).sum(axis=1)))]
    for _ in range(6):
        n = np.sqrt(u @ u)
        if n == 0:
            break
        u = d.T @ (d @ (u / n))
    n = np.sqrt(u @ u)
    return u / n if n else u


def grow(x: np.ndarray, rows: np.ndarray, low: int, high: int, leaf: int) -> Ball:
    own = x[rows]
    center = own.mean(axis=0)
    far = own - center
    out = Ball(rows, center, float(np.sqrt((far * far).sum(axis=1).max())), float(np.sqrt(center @ center)), low, high)
    if len(rows) > leaf:
        order = rows[np.argsort(own @ direction(own), kind="stable")]
        half = len(order) // 2
        out.parts = (grow(x, order[:half], low, high, leaf), grow(x, order[half:], low, high, leaf))
    return out


def by_label(x: np.ndarray, labels: np.ndarray, leaf: int) -> list[Ball]:
    """A tree for the rows of each label."""
    order = np.argsort(labels, kind="stable")
    cut = np.flatnonzero(np.diff(labels[order])) + 1
    return [grow(x, rows, int(labels[rows[0]]), int(labels[rows[0]]), leaf) for rows in np.split(order, cut)] if len(order) else []


def interval(a: Ball, c: Ball) -> tuple[float, float]:
    """Bounds of the inner products of a row of one ball and a row of the other."""
    middle, slack = float(a.center @ c.center), a.radius * c.norm + c.radius * a.norm + a.radius * c.radius
    slack += 1 + 1e-9 * (abs(middle) + slack)  # more than the rounding of sums and roots
    return middle - slack, middle + slack


# ---- what a group of anchors asks for


@dataclass
class Group:
    """Anchors of one cell and label, and for each anchor windows of scores: from least to most, k rows each."""

    cell: int
    label: int
    keys: bytes
    vectors: bytes
    least: np.ndarray
    most: np.ndarray

    COLUMNS = "cell int, label int, keys binary, vectors binary, least binary, most binary"

    @staticmethod
    def of(row: dict) -> Group:
        n = len(row["keys"]) // 16
        least, most = (np.frombuffer(row[c], np.int64).reshape(n, -1).copy() for c in ("least", "most"))
        return Group(row["cell"], row["label"], row["keys"], row["vectors"], least, most)

    def part(self, rows: np.ndarray, width: int) -> tuple:
        """The columns of some of the anchors."""
        cut = lambda cell, n: np.frombuffer(cell, f"V{n}")[rows].tobytes()
        return self.cell, self.label, cut(self.keys, 16), cut(self.vectors, width), self.least[rows].tobytes(), self.most[rows].tobytes()


@dataclass(frozen=True)
class Shape:
    """How vectors are packed, and whether inner products are exact in doubles."""

    width: int
    kind: str
    exact: bool

    @property
    def bytes(self) -> int:
        return self.width * np.dtype(self.kind).itemsize

    @property
    def block_rows(self) -> int:
        return max(256, (4 << 20) // (8 * max(1, self.width)))

    def matrix(self, cells: bytes, n: int) -> np.ndarray:
        return np.frombuffer(cells, self.kind).reshape(n, self.width)

    def scores(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a.astype(float) @ c.astype(float).T).astype(np.int64) if self.exact else a.astype(np.int64) @ c.astype(np.int64).T


class Search:
    """The rows that lie in the windows of a group's anchors: fills hits, raises least."""

    def __init__(self, group: Group, vectors: np.ndarray, k: int, same: bool) -> None:
        self.group, self.vectors, self.k, self.same = group, vectors, k, same
        self.least, self.most = group.least.copy(), group.most
        self.hits = np.zeros((3, 0), np.int64)  # anchor, row, score
        self._limits()

    def _limits(self) -> None:
        """Per anchor: the lowest and the highest score that any of its windows takes."""
        empty = self.least > self.most
        self.floor = np.where(empty, FAR, self.least).min(axis=1)
        self.top = np.where(empty, -FAR, self.most).max(axis=1)

    def wants(self, a: Ball, c: Ball, low: float, high: float) -> bool:
        if self.same and not c.low <= self.group.label <= c.high or not self.same and c.low == c.high == self.group.label:
            return False
        return bool(((self.floor[a.rows] <= high) & (self.top[a.rows] >= low)).any())

    def pairs(self, a: Ball, candidates: list[Ball]) -> Iterator[tuple[Ball, Ball]]:
        """The pairs of leaves that are left, those with the highest scores in reach first."""
        heap: list = []
        made = 0

        def push(a: Ball, c: Ball) -> None:
            nonlocal made
            low, high = interval(a, c)
            if self.wants(a, c, low, high):
                made += 1
                heapq.heappush(heap, (-min(high, float(self.top[a.rows].max())), made, a, c, low, high))

        for c in candidates:
            push(a, c)
        while heap:
            *_, x, c, low, high = heapq.heappop(heap)
            if not self.wants(x, c, low, high):  # the bar may have risen since
                continue
            if not x.parts and not c.parts:
                yield x, c
            elif c.parts and (not x.parts or c.radius >= x.radius):
                for p in c.parts:
                    push(x, p)
            else:
                for p in x.parts:
                    push(p, c)

    def score(self, a: Ball, c: Ball, rows: np.ndarray, shape: Shape) -> None:
        """Score a pair of leaves exactly, and raise the bar."""
        s = shape.scores(self.vectors[a.rows], rows[c.rows])
        i, j = np.nonzero((s >= self.floor[a.rows][:, None]) & (s <= self.top[a.rows][:, None]))
        if not len(i):
            return
        self.hits = np.hstack([self.hits, np.stack([a.rows[i], c.rows[j], s[i, j]])])
        anchor, _, score = self.hits
        kept = np.zeros(len(anchor), bool)
        for w in range(self.least.shape[1]):
            inside = np.flatnonzero((score >= self.least[anchor, w]) & (score <= self.most[anchor, w]))
            inside = inside[np.lexsort((-score[inside], anchor[inside]))]
            first = np.searchsorted(anchor[inside], anchor[inside])
            last = inside[np.arange(len(inside)) - first == self.k - 1]
            self.least[anchor[last], w] = np.maximum(self.least[anchor[last], w], score[last])
            kept[inside[score[inside] >= self.least[anchor[inside], w]]] = True
        self.hits = self.hits[:, kept]
        self._limits()

    def found(self, ids: list[np.ndarray]) -> Iterator[tuple[bytes, int, int, int]]:
        """(key, window, score, vec_id): for each window the k best of this block, by score and id."""
        anchor, row, score = self.hits
        for w in range(self.least.shape[1]):
            inside = np.flatnonzero((score >= self.least[anchor, w]) & (score <= self.most[anchor, w]))
            n = np.fromiter((len(ids[r]) for r in row[inside]), np.int64, len(inside))
            every = np.repeat(inside, n)
            own = np.concatenate([ids[r] for r in row[inside]]) if len(inside) else np.zeros(0, np.int64)
            order = np.lexsort((own, -score[every], anchor[every]))
            at = anchor[every][order]
            order = order[np.arange(len(order)) - np.searchsorted(at, at) < self.k]
            for i in order:
                a = int(anchor[every[i]])
                yield self.group.keys[16 * a : 16 * a + 16], w, int(score[every[i]]), int(own[i])


# ---- tables


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (as the contract changes it) and the vector, of rows that take part."""
    e = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["label"].cast("int").alias("label"), embeddings["embedding"].cast("array<double>").alias("x"))
    e = e.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    return e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def shape_of(e: DataFrame) -> tuple[Shape, int]:
    n, width, most = e.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).collect()[0]
    most = 256 * (most or 0.0) + 1
    if most >= 1 << 31:
        raise ValueError(f"components up to {most:.3g}: their inner products do not fit in 64 bits")
    return Shape(max(1, width or 0), "<i2" if most < 1 << 15 else "<i4", (width or 0) * most * most < 1 << 53), n


def packed(e: DataFrame, shape: Shape) -> DataFrame:
    """(vec_id, label, v): floor(256 x) as packed integers, one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            offsets = x.offsets.to_numpy()
            n = np.diff(offsets)
            out = np.zeros((len(x), shape.width), shape.kind)
            at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], n)
            out[np.repeat(np.arange(len(x)), n), at] = np.floor(256 * x.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.ascontiguousarray(out).view(f"V{shape.bytes}").ravel().tolist(), pa.binary())], names=["vec_id", "label", "v"])

    rows = e.select("vec_id", "label", "x").mapInArrow(run, "vec_id bigint, label int, v binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def key_of(v: Column, label: Column) -> Column:
    return F.unhex(F.md5(F.concat(v, label.cast("string").cast("binary"))))


class TopTree:
    """A complete binary tree of splits; leaves are cells.  Fitted on a sample, measured on all rows."""

    def __init__(self, x: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.w, self.c = np.zeros((1 << depth, x.shape[1])), np.zeros(1 << depth)
        self.center = np.zeros((2 << depth, x.shape[1]))
        self._fit(x.astype(float), 1)

    def _fit(self, x: np.ndarray, node: int) -> None:
        self.center[node] = x.mean(axis=0) if len(x) else self.center[node >> 1]
        if node >= 1 << self.depth:
            return
        if len(x) > 1:
            self.w[node] = direction(x)
            p = x @ self.w[node]
            self.c[node] = np.median(p) if np.median(p) < p.max() else (p.min() + p.max()) / 2
        right = x @ self.w[node] > self.c[node]
        self._fit(x[~right], 2 * node)
        self._fit(x[right], 2 * node + 1)

    def path(self, x: np.ndarray) -> list[np.ndarray]:
        """The node of each row at every level."""
        node, out = np.ones(len(x), np.int64), []
        for _ in range(self.depth):
            out.append(node)
            node = 2 * node + ((x * self.w[node]).sum(axis=1) > self.c[node])
        return [*out, node]

    def balls(self, measured: dict[int, tuple[float, int, int]]) -> list[Ball]:
        def ball(node: int) -> Ball:
            r, low, high = measured[node]
            return Ball(np.array([node]), self.center[node], r, float(np.sqrt(self.center[node] @ self.center[node])), low, high, tuple(ball(c) for c in (2 * node, 2 * node + 1) if c in measured))

        return [ball(1)] if 1 in measured else []


def routed(df: DataFrame, tree: TopTree, shape: Shape, columns: list[str], kinds: str) -> DataFrame:
    """df(v, ...) with ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shape.matrix(b"".join(b.column(0).to_pylist()), b.num_rows).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.path(x)[-1].astype(np.int32))], names=["v", *columns, "cell"])

    return df.select("v", *columns).mapInArrow(run, f"v binary, {kinds}, cell int")


def measure(rows: DataFrame, tree: TopTree, shape: Shape) -> tuple[dict[int, tuple[float, int, int]], dict[int, int]]:
    """Of each node: radius and range of labels; of each cell: its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, label = shape.matrix(b"".join(b.column(0).to_pylist()), b.num_rows).astype(float), b.column(1).to_numpy().astype(np.int64)
            nodes, far = [], []
            for at in tree.path(x):
                d = x - tree.center[at]
                nodes.append(at)
                far.append(np.sqrt((d * d).sum(axis=1)))
            node, inverse = np.unique(np.concatenate(nodes), return_inverse=True)
            r, low, high = np.zeros(len(node)), np.full(len(node), FAR), np.full(len(node), -FAR)
            np.maximum.at(r, inverse, np.concatenate(far))
            every = np.tile(label, len(nodes))
            np.minimum.at(low, inverse, every)
            np.maximum.at(high, inverse, every)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(r), pa.array(low), pa.array(high), pa.array(np.bincount(inverse))], names=["node", "r", "low", "high", "n"])

    per = rows.select("v", "label").mapInArrow(run, "node bigint, r double, low bigint, high bigint, n bigint")
    got = per.groupBy("node").agg(F.max("r"), F.min("low"), F.max("high"), F.sum("n")).collect()  # at most 2 * MAX_CELLS rows
    return {r[0]: (r[1] * (1 + 1e-9) + 1e-6, r[2], r[3]) for r in got}, {r[0]: r[4] for r in got if r[0] >= 1 << tree.depth}


def grouped(anchors: DataFrame, shape: Shape, partitions: int) -> DataFrame:
    """anchors(cell, label, key, v, least, most) -> rows of Group, at most GROUP anchors of a cell and label each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            n = max(len(r["least"]) for r in held)
            pad = lambda c, fill: np.array([[*r[c], *[fill] * (n - len(r[c]))] for r in held], np.int64).tobytes()
            row = [held[0]["cell"], held[0]["label"], b"".join(r["key"] for r in held), b"".join(r["v"] for r in held), pad("least", FAR), pad("most", -FAR)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["cell", "label", "keys", "vectors", "least", "most"])

        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) == GROUP or (held[0]["cell"], held[0]["label"]) != (r["cell"], r["label"])):
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    at = anchors.select("cell", "label", "key", "v", "least", "most").repartitionByRange(partitions, "cell", "label", "key")
    return at.sortWithinPartitions("cell", "label", "key").mapInArrow(run, Group.COLUMNS)


class Field:
    """The candidates in their cells and blocks, and the rounds over them."""

    def __init__(self, rows: DataFrame, tree: TopTree, shape: Shape) -> None:
        spark = rows.sparkSession
        self.tree, self.shape = tree, shape
        self.measured, n = measure(rows, tree, shape)
        self.blocks = {cell: -(-k // shape.block_rows) for cell, k in n.items()}
        # a row per cell, at most MAX_CELLS
        dealt = F.broadcast(spark.createDataFrame(list(self.blocks.items()), "at int, blocks bigint"))
        self.rows = rows.join(dealt, F.col("cell") == F.col("at")).select("cell", F.pmod(F.xxhash64("v", "label"), "blocks").cast("int").alias("block"), "v", "label", "ids")

    def plan(self, groups: DataFrame, k: int, same: bool, seed: bool) -> DataFrame:
        """Each group with the cells (``to_cell``, ``to_block``) that it must visit; a seed visits one block of its own cell."""
        shape, blocks, measured, tree = self.shape, self.blocks, self.measured, self.tree

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = tree.balls(measured)
            for b in batches:
                for r in b.to_pylist():
                    g = Group.of(r)
                    n = len(g.least)
                    out: list[tuple] = []
                    if seed:
                        if g.cell in blocks:
                            out.append((g.cell, 0, *g.part(np.arange(n), shape.bytes)))
                    else:
                        x = shape.matrix(g.vectors, n).astype(float)
                        visits: dict[int, list[np.ndarray]] = {}
                        for a, c in Search(g, x, k, same).pairs(grow(x, np.arange(n), g.label, g.label, LEAF_ANCHORS), top):
                            visits.setdefault(int(c.rows[0]), []).append(a.rows)
                        for cell, rows in visits.items():
                            part = g.part(np.sort(np.concatenate(rows)), shape.bytes)
                            out += [(cell, block, *part) for block in range(blocks[cell])]
                    for x in out:
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (*[pa.int32()] * 4, *[pa.binary()] * 4), strict=True)], names=["to_cell", "to_block", "cell", "label", "keys", "vectors", "least", "most"])

        return groups.mapInArrow(run, f"to_cell int, to_block int, {Group.COLUMNS}")

    def meet(self, planned: DataFrame, k: int, same: bool, answer: Callable, schema: str, names: list[str]) -> DataFrame:
        """Groups and the blocks that they visit, side by side: a block's rows come first, then its groups one by one."""
        shape = self.shape
        none = lambda kind: F.lit(None).cast(kind)
        rows = self.rows.select(F.col("cell").alias("to_cell"), F.col("block").alias("to_block"), F.lit(0).alias("kind"), "label", "v", "ids", none("int").alias("cell"), *[none("binary").alias(c) for c in ("keys", "least", "most")])
        asked = planned.select("to_cell", "to_block", F.lit(1).alias("kind"), "label", F.col("vectors").alias("v"), none("array<bigint>").alias("ids"), "cell", "keys", "least", "most")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, block = None, [], None
            for b in batches:
                out: list[tuple] = []
                for r in b.to_pylist():
                    if at != (r["to_cell"], r["to_block"]):
                        at, held, block = (r["to_cell"], r["to_block"]), [], None
                    if not r["kind"]:
                        held.append((r["v"], r["label"], np.array(r["ids"], np.int64)))
                        continue
                    if not held:
                        continue
                    if block is None:
                        x = shape.matrix(b"".join(h[0] for h in held), len(held))
                        block = x, by_label(x.astype(float), np.array([h[1] for h in held]), LEAF_ROWS), [h[2] for h in held]
                    g = Group.of({**r, "vectors": r["v"]})
                    x = shape.matrix(g.vectors, len(g.least))
                    s = Search(g, x, k, same)
                    for a, c in s.pairs(grow(x.astype(float), np.arange(len(x)), g.label, g.label, LEAF_ANCHORS), block[1]):
                        s.score(a, c, block[0], shape)
                    out += answer(s, block[2])
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)

        kinds = pa.schema([(f.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])
        n = min(20_000, max(1, sum(self.blocks.values())))
        both = rows.unionByName(asked).repartition(n, "to_cell", "to_block").sortWithinPartitions("to_cell", "to_block", "kind")
        return both.mapInArrow(run, schema)

    def seeded(self, groups: DataFrame, k: int, same: bool) -> DataFrame:
        """The groups with what one block of their own cell raises their bars to."""
        raised = lambda s, ids: [(s.group.cell, s.group.label, s.group.keys, s.group.vectors, s.least.tobytes(), s.most.tobytes())]
        return self.meet(self.plan(groups, k, same, True), k, same, raised, Group.COLUMNS, ["cell", "label", "keys", "vectors", "least", "most"])

    def search(self, groups: DataFrame, k: int, same: bool) -> DataFrame:
        """(key, window, score, vec_id): the k best rows of every window."""
        planned = self.plan(self.seeded(groups, k, same), k, same, False)
        found = self.meet(planned, k, same, lambda s, ids: list(s.found(ids)), "key binary, window int, score bigint, vec_id bigint", ["key", "window", "score", "vec_id"])
        place = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("place", place).where(F.col("place") <= k)


def top_tree(rows: DataFrame, shape: Shape, n: int) -> TopTree:
    """Fitted on at most SAMPLE_ROWS rows, those with the smallest hash of their id."""
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    some = rows.where(h < int(min(1.0, 2 * SAMPLE_ROWS / max(1, n)) * (1 << 30))).orderBy(h, "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    x = np.unique(shape.matrix(b"".join(bytes(r["v"]) for r in some), len(some)), axis=0) if some else np.zeros((0, shape.width))
    cells = min(MAX_CELLS, max(1, len(x) // 16), -(-n // shape.block_rows))
    return TopTree(x, int(np.ceil(np.log2(max(1, cells)))))


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: see op12's contract."""
    spark = embeddings.sparkSession
    ship(spark)
    e = prepared(embeddings)
    shape, n = shape_of(e)
    rows = materialize(packed(e, shape), "vectors")
    tree = top_tree(rows, shape, n)

    held = positives + 1  # an anchor is among the rows
    place = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    folded = rows.withColumn("place", place).where(F.col("place") <= held).groupBy("v", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    field = Field(materialize(routed(folded, tree, shape, ["label", "ids"], "label int, ids array<bigint>"), "candidates"), tree, shape)
    n_groups = max(1, sum(field.blocks.values()))

    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), key_of(F.col("v"), F.col("label")).alias("key"), "v", "label")
    distinct = anchors.groupBy("key").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.min("anchor_id").alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(routed(distinct, tree, shape, ["key", "label", "first", "n"], "key binary, label int, first bigint, n bigint"), "anchors")

    asked = distinct.select("*", F.array(F.lit(-FAR)).alias("least"), F.array(F.lit(FAR)).alias("most"))
    near = field.search(grouped(asked, shape, n_groups), held, True)
    near = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("near"))
    near = materialize(near, "positives")

    # a window for each score of a positive; the only anchor of its key is no positive
    windows = distinct.join(near, "key").withColumn("scores", F.array_sort(F.array_distinct(F.transform(F.filter("near", lambda p: (F.col("n") > 1) | (p["vec_id"] != F.col("first"))), lambda p: p["score"]))))
    windows = windows.withColumn("scores", F.filter("scores", lambda s: s >= 0))
    windows = windows.withColumn("least", F.transform("scores", lambda s: s - F.floor(s / 2))).withColumn("most", F.transform("scores", lambda s: F.floor(95 * s / 100)))
    windows = materialize(windows.where(F.size("scores") > 0).select("key", "v", "label", "cell", "scores", "least", "most"), "windows")
    hard = field.search(grouped(windows, shape, n_groups), negatives, False)
    hard = hard.join(windows.select("key", "scores"), "key").select("key", F.element_at("scores", F.col("window") + 1).alias("positive_score"), F.struct(F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).alias("one"))
    hard = hard.groupBy("key", "positive_score").agg(F.sort_array(F.collect_list("one")).alias("hard"))
    by_key = hard.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("positive_score", "hard"))).alias("hard"))

    one = anchors.select("anchor_id", "key").join(near.join(by_key, "key"), "key")
    own = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("anchor_id")), 1, positives)
    one = one.select("anchor_id", "hard", F.explode(own).alias("p")).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(F.try_element_at("hard", F.col("p.score"))).alias("h"))
    return one.select("anchor_id", "positive_id", F.col("h.rank").cast("int").alias("rank"), F.col("h.negative_id").alias("negative_id"), "positive_score", F.col("h.negative_score").alias("negative_score"))


ORACLE = """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = anchor_label),
    n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
          FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE place <= 5 AND s.label <> p.anchor_label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
