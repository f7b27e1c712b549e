"""Quality scores from a sparse rule ensemble.

Text statistics are Spark columns.  Boosted shallow trees, fitted on a bounded sample of
labelled rows, give their paths as conjunctive rules; a lasso logistic regression keeps few
of them; what is left is compiled into one Spark column, so that scoring stays in the JVM.

The sample is bounded by max_rows (a parameter): the labelled rows with the smallest hash
of their id.  Rows with crc32(doc_id) mod 5 = 0 never take part.

Defined cases: null text counts as empty; empty texts get a score like any other; a table
without usable labels gives 0.5 everywhere; several labels of one id count by their
smallest; a null id is not held out; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def statistics(text: Column) -> dict[str, Column]:
    """Names and expressions of the statistics; all are finite for every text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    words, lines = F.split(t, r"\s+"), F.split(t, "\n")
    n_words = F.size(words).cast("double")
    n_lines = F.size(lines).cast("double")
    per_word = lambda c: c / F.greatest(n_words, F.lit(1.0))
    return {
        "log_words": F.log1p(n_words),
        "mean_word": n / n_words,
        "caps_words": per_word(count(r"\p{Lu}{2,}")),
        "symbol_runs": per_word(count(r"[%&*#$@^~<>{}\[\]\\_=+]+")),
        "bangs": per_word(count(r"[!?]{2,}")),
        "pipes": per_word(count(r"[|\t;]")),
        "digit_runs": per_word(count(r"[0-9]+")),
        "sentence_ends": per_word(count(r"[.!?](?:\s|$)")),
        "commas": per_word(count(r",")),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_per_line": F.log1p(n_words / n_lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_at_most, threshold), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def column(self, stats: dict[str, Column]) -> Column:
        total: Column = F.lit(self.intercept)
        for r in self.rules:
            cond = None
            for name, low, cut in r.terms:
                c = stats[name] <= F.lit(cut) if low else stats[name] > F.lit(cut)
                cond = c if cond is None else cond & c
            total = total + F.when(cond, F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, out: list, min_rows: int) -> None:
    """A regression tree on gradients; appends (path, value) of every node below the root."""
    if path:
        out.append((path, float(-g[rows].sum() / (h[rows].sum() + 1.0)), rows, depth))
    if depth == 0 or len(rows) < 2 * min_rows:
        return
    best, total_g, total_h = (1e-9, -1, 0.0), g[rows].sum(), h[rows].sum()
    parent = total_g**2 / (total_h + 1.0)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        at = np.searchsorted(c, x[rows, j], side="left")  # value <= c[k] for k >= at
        cg = np.cumsum(np.bincount(at, g[rows], len(c) + 1))[:-1]
        ch = np.cumsum(np.bincount(at, h[rows], len(c) + 1))[:-1]
        cn = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
        gain = cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - parent
        gain[(cn < min_rows) | (len(rows) - cn < min_rows)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(c[k]))
    if best[1] < 0:
        return
    _, j, cut = best
    left = x[rows, j] <= cut
    _tree(x, g, h, rows[left], cuts, depth - 1, (*path, (j, True, cut)), out, min_rows)
    _tree(x, g, h, rows[~left], cuts, depth - 1, (*path, (j, False, cut)), out, min_rows)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 2e-3, steps: int = 1500) -> Model:
    """Boost trees for rules, then weigh the rules by lasso logistic regression (FISTA)."""
    n = len(y)
    if n == 0:
        return Model(0.0, ())
    base = float(np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2)))
    if n < 20 or y.min() == y.max():
        return Model(float(np.log(base / (1 - base))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    f, paths = np.full(n, np.log(base / (1 - base))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        nodes: list = []
        _tree(x, p - y, p * (1 - p), np.arange(n), cuts, depth, (), nodes, max(5, n // 200))
        if not nodes:
            break
        parents = {path[:-1] for path, *_ in nodes}
        for path, value, rows, _ in nodes:
            paths[tuple(sorted(path))] = True
            if path not in parents:
                f[rows] += rate * value
    rules = sorted(paths)
    if not rules:
        return Model(float(np.log(base / (1 - base))), ())
    a = np.ones((n, len(rules)))
    for k, path in enumerate(rules):
        for j, low, cut in path:
            a[:, k] *= x[:, j] <= cut if low else x[:, j] > cut
    mean, scale = a.mean(axis=0), a.std(axis=0)
    keep = scale > 1e-6
    a, mean, scale, rules = (a[:, keep] - mean[keep]) / scale[keep], mean[keep], scale[keep], [r for r, k in zip(rules, keep, strict=True) if k]
    step = 4.0 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, b, z, zb, t = np.zeros(len(rules)), np.log(base / (1 - base)), np.zeros(len(rules)), np.log(base / (1 - base)), 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(a @ z + zb))) - y) / n
        nw = z - step * (a.T @ r)
        nw, nb = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0), zb - step * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return Model(
        float(b - (w * mean / scale).sum()),
        tuple(Rule(tuple((names[j], low, cut) for j, low, cut in path), float(wk / s)) for path, wk, s in zip(rules, w, scale, strict=True) if abs(wk) > 1e-9),
    )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model:
    """Fit on at most max_rows labelled rows of docs."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers: small enough for every executor by its bound
    stats = statistics(F.col("text"))
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(picked.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
        .select("label_id", "quality", *[c.alias(k) for k, c in stats.items()]).groupBy("label_id").agg(*[F.min(k).alias(k) for k in ("quality", *stats)]).toPandas()
    )
    rows = rows.sort_values("label_id")
    names = list(stats)
    return fit_rules(rows[names].to_numpy(float), (rows["quality"].to_numpy() > 0).astype(float), names)


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, max_rows)
    stats = statistics(F.col("text"))
    # the statistics are columns of their own first, so that each is computed once
    s = docs.select("doc_id", *[c.alias(k) for k, c in stats.items()])
    s = s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column({k: F.col(k) for k in stats}).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    model = train(docs, labels, max_rows)
    stats = statistics(F.col("text"))
    own = {k: f"linefold_quality_{k}" for k in stats}
    s = docs.select("*", *[c.alias(own[k]) for k, c in stats.items()])
    s = s.select(*[F.col(f"`{c}`") for c in docs.columns], model.column({k: F.col(own[k]) for k in stats}).alias("linefold_quality"))
    # Filters are not pushed below an observation.  Below the projection, this one would compute
    # every statistic again in every rule, without the code that shares their common parts.
    s = s.observe("linefold_quality_scored", F.count(F.lit(1)).alias("rows"))
    return s.where(F.col("linefold_quality") >= threshold).drop("linefold_quality")
