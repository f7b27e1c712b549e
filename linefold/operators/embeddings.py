"""Frozen encoders over text columns: each different text once, in batches, pooled over its tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

_WORD = re.compile(r"[^ \t\n\r\f\v]+")
#: texts of a batch -> token vectors (texts, tokens, dimensions) and the mask of those that are real (texts, tokens)
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def masked_mean(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of each text's real token vectors; zeros where it has none."""
    m = mask.astype(float)[:, :, None]
    return (vectors * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)


def hashed_encoder(dimensions: int = 4, most: int = 512) -> Encoder:
    """An encoder that needs no weights: a token's vector is the bytes of its md5 over 255; texts are cut to their first tokens."""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [_WORD.findall(t.lower())[:most] for t in texts]
        n = max(map(len, words), default=0)
        out, mask = np.zeros((len(texts), n, dimensions)), np.zeros((len(texts), n), bool)
        for i, ws in enumerate(words):
            mask[i, : len(ws)] = True
            for j, w in enumerate(ws):
                out[i, j] = np.frombuffer(hashlib.md5(w.encode()).digest()[:dimensions], np.uint8) / 255
        return out, mask

    return encode


def embed(docs: DataFrame, load: Callable[[], Encoder], id_col: str = "doc_id", text_col: str = "text", batch: int = 16) -> DataFrame:
    """(id, embedding): the pooled vector of each text; null counts as empty.

    load makes the encoder once per task.  Equal texts are encoded once: they meet by digest,
    an aggregation that keeps one of them, and the vectors are joined back.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    texts = keyed.groupBy("digest").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = masked_mean(*encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["key", "embedding"])

    vectors = texts.mapInArrow(run, "key string, embedding array<double>")
    return keyed.select("id", "digest").join(vectors, F.col("digest") == F.col("key")).select("id", "embedding")
