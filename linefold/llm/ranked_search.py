"""Ranked lexical search: document-sharded postings with precomputed integer impacts.

index() deals the documents over shards, each a row with its own vocabulary and its postings
by term (offsets, documents, impacts): all terms of all documents, exact, without hashing.
search() takes a query set in blocks; every shard adds up the impacts of an item's terms in
one dense array of its documents, term at a time, keeps its best with all ties decided, and
the shards' best are merged.

Terms are maximal runs of ASCII letters and digits and of all characters above 127, A-Z
lower-cased.  All arithmetic but the logarithm of a term's weight is 64-bit integer.

Defined cases: null or empty texts have no terms and are in no result; an item without
terms, or without a document that scores above 0, has no rows; rows repeated in either
table count as often as they stand; a document without id counts and ranks last among equal
scores; very long texts are a shard of their own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.statistics import running
from ..runtime import materialize, ship

#: Bytes that belong to terms, lower-cased; all others become a space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Statistics:
    """Documents with at least one term, and all their terms."""

    n_docs: int
    n_terms: int


@dataclass(frozen=True)
class Index:
    shards: DataFrame
    statistics: Statistics


def corpus_statistics(docs: DataFrame, text: str = "text") -> Statistics:
    """Counted where the texts lie, as the index counts them; a row per task comes back to be summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for b in batches:
            for t in b.column(0):
                n = len(terms_of(t.as_py()))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["n_docs", "n_terms"])

    r = docs.select(docs[text]).mapInArrow(run, "n_docs bigint, n_terms bigint").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).collect()[0]
    return Statistics(int(r[0]), int(r[1]))


def impacts(tf: np.ndarray, n: np.ndarray, s: Statistics) -> np.ndarray:
    """What a term that stands tf times in a document of n terms adds, before its weight."""
    m = 100 - 75 + (75 * n * s.n_docs) // s.n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(texts: list[list[bytes]], s: Statistics) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The sorted vocabulary of some documents, and by term: offsets, documents, impacts."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.fromiter((number[w] for t in texts for w in t), np.int64, int(n.sum()))
    vocabulary = sorted(number)
    place = np.empty(len(vocabulary), np.int64)
    place[np.fromiter((number[w] for w in vocabulary), np.int64, len(vocabulary))] = np.arange(len(vocabulary))
    pair, tf = np.unique(place[at] * max(1, len(texts)) + np.repeat(np.arange(len(texts)), n), return_counts=True)
    term, doc = np.divmod(pair, max(1, len(texts)))
    offsets = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    return vocabulary, offsets, doc, impacts(tf.astype(np.int64), n[doc], s)


_SHARD = "doc_ids array<bigint>, terms binary, offsets binary, docs binary, impacts binary"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = 400_000) -> Index:
    """Every document in a shard of about shard_terms terms, written once."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).where("text IS NOT NULL")
    s = corpus_statistics(src)

    def shard(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        vocabulary, offsets, doc, impact = postings(texts, s)
        cell = lambda a: pa.array([a.astype(np.int32).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([b" ".join(vocabulary)], pa.binary()), cell(offsets), cell(doc), cell(impact)],
            names=["doc_ids", "terms", "offsets", "docs", "impacts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        size = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                if size and size + len(terms) > shard_terms:
                    yield shard(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(terms)
                size += len(terms)
        if texts:
            yield shard(ids, texts)

    return Index(materialize(src.mapInArrow(run, _SHARD), "postings"), s)


def _vocabulary(cell: bytes) -> dict[bytes, int]:
    return {w: k for k, w in enumerate(cell.split(b" "))}


def document_frequencies(shards: DataFrame, terms: list[bytes]) -> np.ndarray:
    """In how many documents each of the given terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            for vocabulary, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                have, n = _vocabulary(vocabulary), np.diff(np.frombuffer(offsets, np.int32))
                for k, t in enumerate(terms):
                    if (at := have.get(t)) is not None:
                        df[k] += n[at]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in shards.select("terms", "offsets").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of a block of items
        out[r["term"]] = r["df"]
    return out


def weight(s: Statistics, df: int) -> int:
    return math.floor(1000 * math.log((2 * s.n_docs + 2) / (2 * df + 1)))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by the smallest id."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]  # all that tie with the last stay until ids decide
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """The rows (key, text) of items in blocks of at most block_bytes, or of one item."""
    sized = items.select("key", F.octet_length("text").cast("bigint").alias("size")).where("size > 0")
    total = sized.agg(F.sum("size")).collect()[0][0] or 0
    if total <= block_bytes:
        yield items.where(F.octet_length("text") > 0).select("key", "text").orderBy("key").collect()
        return
    placed = materialize(running(sized, ["key"], ["size"]).select(F.col("key").alias("own"), F.floor((F.col("size_upto") - 1) / block_bytes).cast("bigint").alias("block")), "item-blocks")
    for (b,) in placed.select("block").distinct().orderBy("block").toLocalIterator():
        yield items.join(placed.where(F.col("block") == b), F.col("key") == F.col("own")).select("key", "text").orderBy("key").collect()


def search(found: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """items -> item_id, rank, doc_id, score: the k best documents of each item.

    A block of items, at most block_bytes of text (or one item), travels with the tasks;
    the shards are read once a block.
    """
    shards, s = found.shards, found.statistics
    keyed = materialize(items.select(F.monotonically_increasing_id().alias("key"), items[id_col].alias("item_id"), items[text_col].alias("text")), "items")
    parts = []
    for block in _blocks(keyed.select("key", "text"), block_bytes):
        counted = [(r["key"], Counter(terms_of(r["text"]))) for r in block]
        terms = sorted({t for _, c in counted for t in c})
        if not terms or not s.n_terms:
            continue
        number = {t: j for j, t in enumerate(terms)}
        df = document_frequencies(shards, terms)
        w = [weight(s, int(d)) for d in df]
        asked = [(key, [(number[t], c[t] * w[number[t]]) for t in c if df[number[t]] and w[number[t]] > 0]) for key, c in counted]

        def run(batches: Iterator[pa.RecordBatch], terms=terms, asked=asked) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, vocabulary, offsets, docs, impact in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
                    at, docs, impact = (np.frombuffer(x, np.int32) for x in (offsets, docs, impact))
                    impact = impact.astype(np.int64)
                    have = _vocabulary(vocabulary)
                    own = [have.get(t, -1) for t in terms]
                    out: list[tuple] = []
                    for key, weights in asked:
                        score = np.zeros(len(ids), np.int64)
                        for t, x in weights:
                            if (j := own[t]) >= 0:
                                a, z = at[j], at[j + 1]
                                score[docs[a:z]] += x * impact[a:z]
                        out += [(key, None if ids[i] == NO_ID else int(ids[i]), int(score[i])) for i in best(score, ids, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*out, strict=True)) or ([], [], []))], names=["key", "doc_id", "score"])

        parts.append(shards.mapInArrow(run, "key bigint, doc_id bigint, score bigint"))
    if not parts:
        parts = [keyed.where("false").select("key", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = every.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(keyed.select(F.col("key").alias("own"), "item_id"), F.col("key") == F.col("own")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
    held AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
    total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM held),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    qc AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM held) GROUP BY ALL),
    tw AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
    part AS (SELECT item_id, doc_id, c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS s
             FROM qc JOIN tw USING (term) JOIN tf USING (term), total),
    scored AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM part GROUP BY ALL),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
