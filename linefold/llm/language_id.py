"""Languages of whole texts by a byte convolutional network.

Bytes are embedded; filters of several widths run over them; the highest value of each
filter in a window goes through a rectifier into a softmax over the languages.  The network
is trained in numpy on windows of a bounded sample of labelled rows, and applied to every
window of every text: windows have a fixed length, each byte begins one place of one window,
and a text's probabilities are the mean over its windows by their bytes.

For scoring, embedding and filters are folded into tables over pairs of bytes, so that a
place costs two look-ups and no product.

Bounds of the sample (parameters): at most max_languages languages, the most frequent ones;
about per_language documents of each, by a hash; windows_each windows of each, spread over
the whole text.  Rows with crc32(doc_id) mod 5 = 0 and rows without lang never take part.

Defined cases: a null text, or one without a letter, is "und" with score 0; without any
labelled row all texts are "und"; with one language every text with a letter has it; a null
id is not held out; rows are independent, so repeated rows agree; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .quality import held_out

WIDTHS = (2, 3, 4)
LENGTH, AHEAD = 256, max(WIDTHS)
UNDETERMINED = "und"


@dataclass
class Network:
    """embed: byte x d, zero at byte 0, which pads; filters by width: (width * d) x filters; dense: features x languages."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    out: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.dense, self.out]


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, LENGTH places and AHEAD bytes more of the next ones, padded with 0."""
    n = max(1, -(-len(text) // LENGTH))
    buf = np.zeros(n * LENGTH + AHEAD, np.uint8)
    buf[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(buf, (n, LENGTH + AHEAD), (LENGTH, 1))


def patches(embedded: np.ndarray, width: int) -> np.ndarray:
    """(windows, LENGTH, width * d): what a filter sees at each place."""
    return np.concatenate([embedded[:, j : j + LENGTH] for j in range(width)], axis=2)


def features(net: Network, x: np.ndarray) -> np.ndarray:
    """The plain form of the network up to the softmax's input features; tables() is the fast one."""
    e = net.embed[x]
    return np.hstack([np.maximum(0, (patches(e, w) @ f + b).max(axis=1)) for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True)])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, labels: list[str], d: int = 8, n_filters: int = 24, steps: int = 800, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> Network:
    """Fit windows x by Adam on the cross-entropy, languages weighted evenly; half of each batch is cut short."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels], np.int64)
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    net = Network(
        languages, rng.normal(0, 0.5, (256, d)).astype(np.float32), [small(w * d, n_filters) for w in WIDTHS], [np.zeros(n_filters, np.float32) for _ in WIDTHS],
        small(n_filters * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    if len(languages) < 2:
        return net
    by_language = [np.flatnonzero(y == c) for c in range(len(languages))]
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(rows, -(-batch // len(languages))) for rows in by_language])
        xb, yb = x[drawn].copy(), y[drawn]
        n = len(drawn)
        short = rng.integers(8, LENGTH, n)
        short[rng.random(n) < 0.5] = LENGTH + AHEAD
        xb[np.arange(LENGTH + AHEAD)[None, :] >= short[:, None]] = 0
        e = net.embed[xb]
        seen, tops, at = [], [], []
        for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
            p = patches(e, w)
            z = p @ f + b
            at.append(z.argmax(axis=1))
            seen.append(p)
            tops.append(z.max(axis=1))
        h = np.maximum(0, np.hstack(tops))
        g = softmax(h @ net.dense + net.out)
        g[np.arange(n), yb] -= 1
        g /= n
        back = (g @ net.dense.T) * (h > 0)
        grads: list[np.ndarray] = [np.zeros_like(net.embed)]
        of_filters, of_bias = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            gk = back[:, k * n_filters : (k + 1) * n_filters]
            hit = seen[k][np.arange(n)[:, None], at[k]]  # the patch under each filter's highest place
            of_filters.append(np.einsum("nf,nfp->pf", gk, hit))
            of_bias.append(gk.sum(axis=0))
            into = gk[:, :, None] * f.T[None]
            for j in range(w):
                np.add.at(grads[0], xb[np.arange(n)[:, None], at[k] + j].ravel(), into[:, :, j * d : (j + 1) * d].reshape(-1, d))
        grads += [*of_filters, *of_bias, h.T @ g, g.sum(axis=0)]
        grads[0][0] = 0
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, q, a, b in zip(net.parameters(), grads, first, second, strict=True):
            a += 0.1 * (q - a)
            b += 0.001 * (q * q - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def tables(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Filter values as sums of two look-ups by pairs of bytes: the first two bytes, and the next two for wider filters."""
    d = net.embed.shape[1]
    part = lambda f, j: net.embed @ f[j * d : (j + 1) * d]
    head, tail = [], []
    for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
        head.append((part(f, 0)[:, None] + part(f, 1)[None] + b).reshape(65536, -1))
        if w > 2:
            tail.append((part(f, 2)[:, None] + (part(f, 3) if w > 3 else np.zeros((256, f.shape[1]), np.float32))[None]).reshape(65536, -1))
    return np.ascontiguousarray(np.hstack(head), np.float32), np.ascontiguousarray(np.hstack(tail), np.float32)


def probabilities(net: Network, folded: tuple[np.ndarray, np.ndarray], x: np.ndarray, chunk: int = 32) -> np.ndarray:
    """Of each window, the languages' probabilities."""
    head, tail = folded
    skip = head.shape[1] - tail.shape[1]
    out = []
    for a in range(0, len(x), chunk):
        w = x[a : a + chunk].astype(np.uint16)
        pair = w[:, :-1] * np.uint16(256) + w[:, 1:]
        z = head[pair[:, :LENGTH]]
        z[:, :, skip:] += tail[pair[:, 2 : LENGTH + 2]]
        out.append(softmax(np.maximum(0, z.max(axis=1)) @ net.dense + net.out))
    return np.concatenate(out)


def of_texts(net: Network, folded: tuple[np.ndarray, np.ndarray], texts: list[bytes], most: int = 1024) -> np.ndarray:
    """Mean probabilities of each text over its windows, by the bytes that they hold."""
    total = np.zeros((len(texts), len(net.languages)))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if held:
            p = probabilities(net, folded, np.concatenate([w for _, w, _ in held]))
            owner = np.repeat([i for i, *_ in held], [len(w) for _, w, _ in held])
            np.add.at(total, owner, p * np.concatenate([n for *_, n in held])[:, None])
        held.clear()

    for i, t in enumerate(texts):
        every = windows(t)
        n = np.minimum(LENGTH, max(1, len(t)) - LENGTH * np.arange(len(every))).astype(float)
        for a in range(0, len(every), most):  # a very long text goes through in parts
            held.append((i, every[a : a + most], n[a : a + most]))
            size += len(held[-1][1])
            if size >= most:
                flush()
                size = 0
    flush()
    return total / np.maximum(1, [len(t) for t in texts])[:, None]


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_languages: int, per_language: int, windows_each: int) -> tuple[np.ndarray, list[str]]:
    """Windows of a bounded sample, and their languages."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    src = src.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    found = src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    if not found:
        return np.zeros((0, LENGTH + AHEAD), np.uint8), []
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in found], "known string, share double")
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    picked = src.withColumn("h", h).join(F.broadcast(share), F.col("lang") == F.col("known")).where(F.col("h") < F.col("share") * (1 << 40))  # max_languages rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lang, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                every = windows(text.encode("utf-8", "surrogatepass"))
                for k in sorted({int(i) for i in np.linspace(0, len(every) - 1, windows_each).round()}):
                    out.append((lang, h, k, every[k].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["lang", "h", "k", "x"])

    # repeated rows share a hash: the limit holds for them too
    rows = picked.select("text", "lang", "h").mapInArrow(run, "lang string, h bigint, k int, x binary").orderBy("h", "k", "lang", "x").limit(2 * len(found) * per_language * windows_each).collect()
    return np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(len(rows), LENGTH + AHEAD), [r["lang"] for r in rows]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 200, per_language: int = 600, windows_each: int = 4) -> Network | None:
    ship(docs.sparkSession)
    x, labels = sample(docs, id_col, text_col, lang_col, max_languages, per_language, windows_each)
    return train(x, labels) if labels else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    src = src.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if net is None:
        return src.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = tables(net)
        for b in batches:
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
            known = [i for i, t in enumerate(texts) if t is not None]
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                p = of_texts(net, folded, [texts[i] for i in known])
                for i, k, v in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = net.languages[k], min(1.0, float(v))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
