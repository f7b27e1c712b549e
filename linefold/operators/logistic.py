"""Balanced logistic regression of many folds at once, over sparse rows that stay where they are.

Every step is one pass: tasks add up the loss and gradient of each fold that their rows
belong to, the sums meet by fold, and the driver takes the folds' L-BFGS steps side by side.
Only weights travel, as many as folds times features and at most so many at a time; rows,
however many, never leave their partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship

KEY = ["rep", "repeat", "fold"]
Key = tuple[str, int, int]


class Rows:
    """A batch of rows as flat arrays: the key of each row, its label, its sparse and its dense part."""

    def __init__(self, batch: pa.RecordBatch, number: dict[Key, int]) -> None:
        c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.key = np.array([number.get(k, -1) for k in zip(*(c[n].to_pylist() for n in KEY), strict=True)], np.int64)
        self.test = c["test"].to_numpy(zero_copy_only=False).astype(bool)
        self.label = c["label"].to_numpy(zero_copy_only=False).astype(float)
        self.at, self.values = c["at"].flatten().to_numpy().astype(np.int64), c["weights"].flatten().to_numpy()
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(c["at"].offsets.to_numpy()))
        self.dense = c["dense"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if "dense" in c and batch.num_rows else np.zeros((batch.num_rows, 0))


def summed(rows: DataFrame, add: Callable[[dict[int, np.ndarray], pa.RecordBatch], None]) -> dict[int, np.ndarray]:
    """Vectors by key, added up in tasks and then by key; add(total, batch) puts a batch's share into total."""

    def out(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "v"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            add(total, b)
        yield out(total)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v)
                total[k] = total[k] + v if k in total else v
        yield out(total)

    found = rows.mapInArrow(part, "k bigint, v binary").repartition("k").mapInArrow(whole, "k bigint, v binary").collect()  # one vector per fold
    return {r["k"]: np.frombuffer(bytes(r["v"])) for r in found}


class Steps:
    """L-BFGS for one fold: hands out trial points, takes their loss and gradient."""

    def __init__(self, size: int, memory: int = 8) -> None:
        self.x = np.zeros(size)
        self.trial, self.scale, self.memory = self.x, 1.0, memory
        self.loss, self.slope, self.gradient, self.moves, self.done = np.inf, 0.0, None, [], False

    def take(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        if self.gradient is not None and loss > self.loss + 1e-4 * self.scale * self.slope + 1e-13 * abs(self.loss):
            self.scale /= 2
            self.done = self.scale < 1e-12
            self.trial = self.x + self.scale * self.way
            return
        if self.gradient is not None:
            s, y = self.trial - self.x, gradient - self.gradient
            if s @ y > 1e-14 * (y @ y):
                self.moves = [*self.moves, (s, y)][-self.memory :]
        self.x, self.loss, self.gradient = self.trial, loss, gradient
        self.done = bool(np.sqrt(gradient @ gradient) < tolerance)
        q, kept = gradient.copy(), []
        for s, y in reversed(self.moves):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.moves:
            s, y = self.moves[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.moves, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        self.way, self.slope = -q, -float(q @ gradient)
        self.scale = 1.0 if self.moves else min(1.0, 1 / np.sqrt(gradient @ gradient)) if gradient.any() else 1.0
        self.trial = self.x + self.scale * self.way


def remembered(weights: int, most: int = 150, numbers: int = 8_000_000) -> int:
    """How many moves to keep of so many weights: every step is a pass over the rows, and with 8 moves it takes several times the steps of 150."""
    return max(8, min(most, numbers // (2 * max(1, weights))))


def _descend(fitted: np.ndarray, size: int, once: Callable[[list[int], np.ndarray], dict[int, np.ndarray]], c: float, tolerance: float, most_steps: int) -> np.ndarray:
    """The weights of each fold that can be fitted, side by side; once(live, trials) gives by place in live the gradient and, last, the loss over its rows."""
    every = [Steps(size, remembered(len(fitted) * size)) for _ in fitted]
    for s, ok in zip(every, fitted, strict=True):
        s.done = not ok
    free = np.full(size, 1 / c)
    free[-1] = 0.0
    for _ in range(most_steps):
        live = [i for i, s in enumerate(every) if not s.done]
        if not live:
            break
        got = once(live, np.stack([every[i].trial for i in live]))
        for i, j in enumerate(live):
            s, v = every[j], got[i]
            s.take(float(v[-1] + (free * s.trial**2).sum() / 2), v[:-1] + free * s.trial, tolerance)
    return np.stack([s.x for s in every])


def _margins(b: Rows, w: np.ndarray, k: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """What each row gets from the weights w[k]: dense part, sparse part, intercept."""
    d = dense.shape[1]
    return (dense * w[k, :d]).sum(axis=1) + np.bincount(b.row, w[k[b.row], d + b.at] * b.values, len(k)) + w[k, -1]


def sparse_scores(rows: DataFrame, c: float = 1.0, tolerance: float = 1e-6, most_steps: int = 300, most_weights: int = 1_000_000) -> DataFrame:
    """rows(rep, repeat, fold, doc, label, test, at, weights) -> (rep, repeat, fold, row_id, label, score) of the test rows.

    The objective of each fold: classes of even weight n / (2 n_c), squared weights over 2 c,
    a free intercept.  A column ``dense``, where rows have it, goes beside the weights,
    standardised on the training rows of its fold.  A fold whose training rows have one class
    gives its share of that class, one without training rows 0.5.  Folds are fitted together
    as long as their weights are at most most_weights, else group by group.
    """
    spark = rows.sparkSession
    ship(spark)
    columns = [*KEY, "doc", "label", "test", "at", "weights", *(["dense"] if "dense" in rows.columns else [])]
    src = rows.select(*columns).withColumns({"rep": F.col("rep").cast("string"), "repeat": F.col("repeat").cast("bigint"), "fold": F.col("fold").cast("bigint"), "label": F.col("label").cast("int"), "at": F.col("at").cast("array<int>"), "weights": F.col("weights").cast("array<double>")})
    if "dense" in columns:
        src = src.withColumn("dense", F.col("dense").cast("array<double>"))
    # rows of a fold lie together, so that a task adds up few folds; a large fold is many parts
    src = materialize(src.repartitionByRange(*KEY, "doc"), "fold-rows")
    train = ~F.col("test")
    facts = src.groupBy(*KEY).agg(
        F.count_if(train).alias("n"), F.coalesce(F.sum(F.when(train, F.col("label"))), F.lit(0)).alias("pos"), F.coalesce(F.max(F.array_max("at")), F.lit(-1)).alias("last"), (F.max(F.size("dense")) if "dense" in columns else F.lit(0)).alias("dense")
    ).collect()  # a row per fold
    schema = f"rep string, repeat bigint, fold bigint, row_id {src.schema['doc'].dataType.simpleString()}, label int, score double"
    if not facts:
        return spark.createDataFrame([], schema)
    facts.sort(key=lambda r: tuple(r[k] for k in KEY))
    width, d = 1 + max(r["last"] for r in facts), max(r["dense"] for r in facts)
    size = d + width + 1
    each = max(1, most_weights // size)
    parts = [_scores_of(src, facts[a : a + each], d, size, c, tolerance, most_steps, schema) for a in range(0, len(facts), each)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scores_of(src: DataFrame, facts: list, d: int, size: int, c: float, tolerance: float, most_steps: int, schema: str) -> DataFrame:
    sc = src.sparkSession.sparkContext
    number = {tuple(r[k] for k in KEY): i for i, r in enumerate(facts)}
    n, pos = np.array([r["n"] for r in facts], float), np.array([r["pos"] for r in facts], float)
    fitted = (pos > 0) & (pos < n)
    weigh = np.stack([n / (2 * np.maximum(1, n - pos)), n / (2 * np.maximum(1, pos))])
    mean, spread = np.zeros((len(facts), d)), np.ones((len(facts), d))
    if d:
        def add_up(total: dict[int, np.ndarray], batch: pa.RecordBatch, mean: np.ndarray, power: int) -> None:
            b = Rows(batch, number)
            for k in np.unique(b.key[(b.key >= 0) & ~b.test]):
                v = ((b.dense[(b.key == k) & ~b.test] - mean[k]) ** power).sum(axis=0)
                total[int(k)] = total[int(k)] + v if int(k) in total else v

        for k, v in summed(src, lambda total, b, m=mean.copy(): add_up(total, b, m, 1)).items():
            mean[k] = v / n[k]
        for k, v in summed(src, lambda total, b, m=mean.copy(): add_up(total, b, m, 2)).items():
            spread[k] = np.sqrt(v / n[k])
        spread[spread == 0] = 1

    def evened(b: Rows, k: np.ndarray) -> np.ndarray:
        return (b.dense - mean[k]) / spread[k] if d else b.dense

    fit_on = src.where(~F.col("test"))

    def once(live: list[int], trials: np.ndarray) -> dict[int, np.ndarray]:
        place = np.full(len(facts), -1)
        place[live] = np.arange(len(live))
        held = sc.broadcast(trials)  # at most most_weights numbers

        def add(total: dict[int, np.ndarray], batch: pa.RecordBatch, held=held, place=place) -> None:
            b = Rows(batch, number)
            k = np.where(b.key >= 0, place[b.key], -1)
            use = (k >= 0) & ~b.test
            k = np.maximum(k, 0)
            dense = evened(b, np.maximum(b.key, 0))
            z = _margins(b, held.value, k, dense)
            w = np.where(use, weigh[b.label.astype(int), np.maximum(b.key, 0)], 0.0)
            loss = w * (np.logaddexp(0, z) - b.label * z)
            pull = w * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - b.label)
            for i in np.unique(k[use]):
                mine = use & (k == i)
                g = np.zeros(size + 1)
                inside = mine[b.row]
                g[d : size - 1] = np.bincount(b.at[inside], pull[b.row[inside]] * b.values[inside], size - 1 - d)
                g[:d], g[size - 1], g[size] = dense[mine].T @ pull[mine], pull[mine].sum(), loss[mine].sum()
                total[int(i)] = total[int(i)] + g if int(i) in total else g

        got = summed(fit_on, add)
        held.destroy()
        return got

    weights = sc.broadcast(_descend(fitted, size, once, c, tolerance, most_steps))
    share = np.where(n > 0, pos / np.maximum(1, n), 0.5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Rows(batch, number)
            k = np.maximum(b.key, 0)
            z = _margins(b, weights.value, k, evened(b, k))
            p = np.where(fitted[k], 1 / (1 + np.exp(-np.clip(z, -700, 700))), share[k])
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(p)], names=[*KEY, "row_id", "label", "score"])
            yield out.filter(pa.array(b.key >= 0))

    return src.where("test").mapInArrow(score, schema)


class Counts:
    """A batch of shared rows as flat arrays, with the norm of each row under each fold."""

    def __init__(self, batch: pa.RecordBatch, n_folds: int) -> None:
        c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.fold, self.label = c["fold"].to_numpy(zero_copy_only=False), c["label"].to_numpy(zero_copy_only=False).astype(float)
        self.at, self.tf = c["at"].flatten().to_numpy(), c["tf"].flatten().to_numpy()
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(c["at"].offsets.to_numpy()))
        self.scale = c["scale"].flatten().to_numpy().reshape(batch.num_rows, n_folds)


def shared_scores(rows: DataFrame, idf: DataFrame, c: float = 1.0, tolerance: float = 1e-6, most_steps: int = 300) -> DataFrame:
    """As sparse_scores(), of what train_fit_counts() gives: (repeat, fold, row_id, label, score) of the test rows.

    A row is kept, read and sent to Python once for all folds of its repeat; what a fold makes
    of its counts is worked out from the fold's idf, a vector.
    """
    spark = rows.sparkSession
    ship(spark)
    by: dict[int, list] = {}
    for r in idf.orderBy("repeat", "at").collect():  # at most folds times vocabulary a repeat
        by.setdefault(r["repeat"], []).append(r["idf"])
    src = rows.select(F.col("repeat").cast("bigint").alias("repeat"), F.col("fold").cast("bigint").alias("fold"), "doc", F.col("label").cast("int").alias("label"), "at", "tf")
    src = materialize(src.repartition("doc"), "shared-rows")
    facts: dict[int, list] = {}
    for r in src.groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect():  # a row per fold
        facts.setdefault(r["repeat"], []).append(r)
    schema = f"repeat bigint, fold bigint, row_id {src.schema['doc'].dataType.simpleString()}, label int, score double"
    out = spark.createDataFrame([], schema)
    for k in sorted(facts):
        weight = np.array(by.get(k, []), float)
        n_folds = weight.shape[1] if len(weight) else 1 + max(r["fold"] for r in facts[k])
        part = _shared_scores_of(src.where(F.col("repeat") == k), facts[k], weight.reshape(-1, n_folds).T, c, tolerance, most_steps, schema)
        out = out.unionByName(part)
    return out


def _shared_scores_of(src: DataFrame, facts: list, idf: np.ndarray, c: float, tolerance: float, most_steps: int, schema: str) -> DataFrame:
    sc = src.sparkSession.sparkContext
    n_folds, width = idf.shape
    own = np.zeros((n_folds, 2))
    for r in facts:
        own[r["fold"]] = r["n"], r["pos"]
    n, pos = (own.sum(axis=0) - own).T
    fitted = (pos > 0) & (pos < n)
    weigh = np.stack([n / (2 * np.maximum(1, n - pos)), n / (2 * np.maximum(1, pos))])
    given = sc.broadcast(idf)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """rows with one over their length in each fold, 0 for rows without a known term."""
        for batch in batches:
            at, tf, rows = batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy(), batch.num_rows
            row = np.repeat(np.arange(rows), np.diff(batch.column(3).offsets.to_numpy()))
            length = np.stack([np.sqrt(np.bincount(row, (tf * v[at]) ** 2, rows)) for v in given.value], axis=1)
            scale = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n_folds), pa.array(scale.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "scale"])

    rows = src.select("fold", "doc", "label", "at", "tf")
    rows = materialize(rows.mapInArrow(scaled, f"fold bigint, doc {rows.schema['doc'].dataType.simpleString()}, label int, at array<int>, tf array<double>, scale array<double>"), "scaled-rows")
    columns = rows.select("fold", "label", "at", "tf", "scale")

    def once(live: list[int], trials: np.ndarray) -> dict[int, np.ndarray]:
        held = sc.broadcast(trials)  # a row per fold

        def add(total: dict[int, np.ndarray], batch: pa.RecordBatch) -> None:
            b = Counts(batch, n_folds)
            for i, k in enumerate(live):
                w, v, s = held.value[i], given.value[k], b.scale[:, k]
                z = np.bincount(b.row, (v * w[:-1])[b.at] * b.tf, len(s)) * s + w[-1]
                even = np.where(b.fold != k, weigh[b.label.astype(int), k], 0.0)
                pull = even * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - b.label)
                g = np.empty(width + 2)
                g[:width] = v * np.bincount(b.at, (pull * s)[b.row] * b.tf, width)
                g[width], g[width + 1] = pull.sum(), (even * (np.logaddexp(0, z) - b.label * z)).sum()
                total[i] = total[i] + g if i in total else g

        got = summed(columns, add)
        held.destroy()
        return got

    weights = sc.broadcast(_descend(fitted, width + 1, once, c, tolerance, most_steps))
    share = np.where(n > 0, pos / np.maximum(1, n), 0.5)
    repeat = facts[0]["repeat"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Counts(batch, n_folds)
            w = weights.value
            z = np.bincount(b.row, (given.value * w[:, :-1])[b.fold[b.row], b.at] * b.tf, len(b.fold)) * b.scale[np.arange(len(b.fold)), b.fold] + w[b.fold, -1]
            p = np.where(fitted[b.fold], 1 / (1 + np.exp(-np.clip(z, -700, 700))), share[b.fold])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), repeat)), batch.column(0), batch.column(1), batch.column(2), pa.array(p)], names=["repeat", "fold", "row_id", "label", "score"])

    return rows.mapInArrow(score, schema)
