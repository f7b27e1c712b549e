"""Removal of repeated byte strings (length L, 100 by default) by suffix sorting.

A byte goes if a string of L bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one.  Strings are judged on the input.

1. Copies.  Equal texts form a class; all but the one of smallest id are covered whole.
2. Anchors.  A window of L bytes picks the smallest k-gram hash inside it, leftmost first.
   Equal windows pick equal k-grams at equal offsets, so a window whose k-gram stands only
   once in the corpus cannot repeat.  This prunes exactly and deals the work by content.
   An anchor's context is the union of the windows that pick it.
3. Equal contexts, by 128-bit digests.  All but the earliest place of a context repeat whole.
4. Difference cover.  The different contexts around one k-gram go to one task, which
   suffix-sorts them: sort the sampled triples (positions 1 and 2 mod 3), name them,
   recurse on the names while names tie, sort the rest by (first byte, rank behind it),
   merge, and compare the L-byte prefixes of neighbours in suffix order.  Of equal windows
   the earliest stays.  Where more than BLOCK contexts share a k-gram, their windows are
   aggregated by 128-bit digest instead, which no group size can hold up.

Nothing that grows with the corpus is collected to the driver or meets in one task: keys of
joins that stand on very many rows are dealt over salts (see _dealt_join).

Defined cases: null text counts as empty; texts shorter than L lose nothing; rows that
repeat an id with the same text are the same document; different texts under one id, or
null ids, are ordered by (id, digest), null first; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from .wordhash import U, mix, prefix, span_hash

LENGTH = 100
K = 32
BLOCK = 50_000
#: A key of a join is hot beyond this many rows, or beyond this share of all, whichever is more.
HOT_ROWS, HOT_SHARE = 4096, 1e-5
#: Ids of copies up to which they are broadcast: a few MB. Beyond, they join by shuffle.
BROADCAST_ROWS = 200_000


# -- difference cover suffix sorting ----------------------------------------------------


def _pack(parts: list[np.ndarray]) -> np.ndarray:
    """One int64 key whose order is that of the tuples."""
    key, bound = parts[0].astype(np.int64), int(parts[0].max(initial=0)) + 1
    for p in parts[1:]:
        m = int(p.max(initial=0)) + 1
        if bound * m >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            bound = len(values)
        key, bound = key * m + p, bound * m
    return key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of integers >= 1, by difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:].tolist())), np.int64)
    t = np.zeros(n + 3, np.int32)
    t[:n] = s
    at = np.arange(n, dtype=np.int32)
    i1, i2, i0 = at[1::3], at[2::3], at[0::3]
    if n % 3 == 1:  # a dummy suffix keeps the two halves of the names apart
        i1 = np.append(i1, np.int32(n))
    sample = np.concatenate([i1, i2])
    triple = _pack([t[sample], t[np.minimum(sample + 1, n + 2)], t[np.minimum(sample + 2, n + 2)]])
    order = np.argsort(triple)
    ranked = triple[order]
    name = np.empty(len(sample), np.int32)
    name[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) + 1
    order12 = order if name.max(initial=0) == len(sample) else suffix_array(name)
    rank = np.zeros(n + 4, np.int32)
    rank[sample[order12]] = np.arange(1, len(sample) + 1)
    sa12 = sample[order12]
    sa12 = sa12[sa12 < n]
    sa0 = i0[np.argsort(_pack([t[i0], rank[i0 + 1]]))]
    # a suffix of class 0 goes behind the smaller ones of either sampled class
    one, two = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    k = _pack([np.concatenate([t[one], t[sa0]]), np.concatenate([rank[one + 1], rank[sa0 + 1]])])
    c1 = np.searchsorted(k[: len(one)], k[len(one) :])
    k = _pack([np.concatenate([t[two], t[sa0]]), np.concatenate([t[two + 1], t[sa0 + 1]]), np.concatenate([rank[two + 2], rank[sa0 + 2]])])
    c2 = np.searchsorted(k[: len(two)], k[len(two) :])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    where = np.arange(len(sa0)) + c1 + c2
    out[where] = sa0
    free[where] = False
    out[free] = sa12
    return out


def equal_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, group) of every window of the contexts; equal windows share a group."""
    size = np.array([len(c) for c in contexts], np.int64)
    buf = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    s = buf.astype(np.int64) + 2
    s[begin + size] = 1  # between contexts, below every byte
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    offset = np.arange(len(buf)) - begin[owner]
    valid = offset + length <= size[owner]
    sa = suffix_array(s)
    sa = sa[valid[sa]]
    # prefixes of neighbours, eight bytes at a time where they are long enough
    step = 8 if length >= 8 else 1
    words = np.lib.stride_tricks.as_strided(buf, (len(buf) - step + 1,), (1,)) if step == 1 else np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    same = np.zeros(len(sa), bool)
    same[1:] = True
    for o in [*range(0, length - step, step), length - step]:
        at = np.flatnonzero(same)
        same[at] = words[sa[at - 1] + o] == words[sa[at] + o]
    return owner[sa], offset[sa], np.cumsum(~same)


# -- anchors ----------------------------------------------------------------------------------


def _slide(v: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over v[i : i + w] for every i that fits, by doubling."""
    out, have = v, 1
    while have < w:
        step = min(have, w - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def anchors_of(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, k-gram hash, two context hashes, first window, last window, anchor) of each anchor of the texts."""
    data = b"".join(texts)
    n = len(data)
    ends = np.cumsum([len(t) for t in texts])
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64), z, z, z
    begins = ends - [len(t) for t in texts]
    buf = np.frombuffer(data, np.uint8)
    sums = prefix(buf)
    at = np.arange(n - k + 1)
    h = span_hash(sums, at, at + k)
    w = length - k + 1
    v = (h >> U(32)).astype(np.uint32) | np.uint32(1)
    low = _slide(v, w, np.minimum)  # per window
    # windows that cross the end of a text are none
    valid = np.zeros(len(low) + 1, np.int32)
    long = ends - begins >= length
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    low[~valid] = 0
    pad = np.zeros(w - 1, np.uint32)
    picked = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), w, np.maximum) == v)
    windows = np.flatnonzero(valid)
    if not len(windows):
        return anchors_of([], length, k)
    # the leftmost smallest position of each window
    nxt = np.searchsorted(picked, windows)
    wrong = np.flatnonzero(v[picked[nxt]] != low[windows])
    while len(wrong):
        nxt[wrong] += 1
        wrong = wrong[v[picked[nxt[wrong]]] != low[windows[wrong]]]
    edge = np.flatnonzero(np.concatenate([[True], nxt[1:] != nxt[:-1]]))
    first, anchor = windows[edge], picked[nxt[edge]]
    last = windows[np.append(edge[1:], len(windows)) - 1]
    ctx = mix(span_hash(sums, first, last + length) + (anchor - first).astype(np.uint64))
    ctx2 = span_hash(prefix(buf, 1), first, last + length, 1)
    text = np.searchsorted(ends, first, side="right")
    return text, h[anchor], ctx, ctx2, first - begins[text], last - begins[text], anchor - begins[text]


def anchors(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """anchors_of() of one text, without its number and the second context hash."""
    _, h, ctx, _, *places = anchors_of([data], length, k)
    return h, ctx, *places


_ANCHOR = "h bigint, ctx bigint, ctx2 bigint, d bigint, first int, last int, anchor int"


def _anchor_rows(texts: DataFrame, length: int, k: int) -> DataFrame:
    """texts(d, text) -> a row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            group: list[bytes] = []
            size, begin = 0, 0
            for i, t in enumerate(b.column(1).to_pylist()):
                group.append((t or "").encode())
                size += len(group[-1])
                # about a cache's worth of text at a time
                if size >= 60_000 or i + 1 == b.num_rows:
                    text, h, ctx, ctx2, first, last, anchor = anchors_of(group, length, k)
                    cols = [h.view(np.int64), ctx.view(np.int64), ctx2.view(np.int64), ids[begin + text].astype(np.int64), first.astype(np.int32), last.astype(np.int32), anchor.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "ctx", "ctx2", "d", "first", "last", "anchor"])
                    group, size, begin = [], 0, i + 1

    return texts.select("d", "text").mapInArrow(run, _ANCHOR)


# -- the steps --------------------------------------------------------------------------------


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted rows are few; else the plain frame, which joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, hot, d, first, body): the bytes of the wanted contexts. wanted: (d, h, first, last, hot)."""
    lists = materialize(wanted.groupBy("d").agg(F.collect_list(F.struct("h", "first", "last", "hot")).alias("want")), "sd-want")
    j = texts.join(lists.withColumnRenamed("d", "wd"), F.col("d") == F.col("wd")).select("d", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = t.encode()
                for x in want:
                    rows.append((x["h"], x["hot"], d, x["first"], data[x["first"] : x["last"] + length]))
                if len(rows) >= 20_000:
                    yield _context_batch(rows)
                    rows = []
            if rows:
                yield _context_batch(rows)

    return j.mapInArrow(run, "h bigint, hot boolean, d bigint, first int, body binary")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("h", pa.int64()), ("hot", pa.bool_()), ("d", pa.int64()), ("first", pa.int32()), ("body", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _runs(d: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """Window starts as runs (d, first, last)."""
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(d)) - 1 if len(d) else cut
    return pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(p[cut].astype(np.int32)), pa.array(p[end].astype(np.int32))], names=["d", "first", "last"])


def _sorted_blocks(contexts: DataFrame, length: int, block_bytes: int = 150_000) -> DataFrame:
    """Repeated windows of contexts, found by suffix sorting, as runs (d, first, last).

    Rows of one k-gram stand together in a task; a block is closed between k-grams.
    """
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.select("h", "d", "first", "body").repartition(n, "h").sortWithinPartitions("h")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        owner, off, group = equal_windows([r[3] for r in rows], length)
        d = np.array([r[1] for r in rows], np.int64)[owner]
        p = np.array([r[2] for r in rows], np.int64)[owner] + off
        order = np.lexsort((p, d, group))
        g = group[order]
        later = order[1:][g[1:] == g[:-1]]  # all but the earliest of each group
        return _runs(d[later], p[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= block_bytes and r[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
                last = r[0]
        if rows:
            yield solve(rows)

    return dealt.mapInArrow(run, "d bigint, first int, last int")


def _hashed_windows(contexts: DataFrame, length: int, hot: int) -> DataFrame:
    """As _sorted_blocks(), for k-grams with very many contexts: windows meet in aggregations only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, d, first, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                buf = np.frombuffer(body, np.uint8)
                at = np.arange(len(body) - length + 1)
                w = [span_hash(prefix(buf, i), at, at + length, i).view(np.int64) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), *map(pa.array, w), pa.array(np.full(len(at), d)), pa.array((first + at).astype(np.int32))], names=["h", "w", "w2", "d", "p"])

    rows = contexts.select("h", "d", "first", "body").mapInArrow(run, "h bigint, w bigint, w2 bigint, d bigint, p int")
    rows = materialize(rows, "sd-hot")
    earliest = rows.groupBy("h", "w", "w2").agg(F.min(F.struct("d", "p")).alias("e"), F.count("*").alias("n")).where("n > 1")
    earliest = materialize(earliest.select("h", "w", "w2", F.col("e.d").alias("ed"), F.col("e.p").alias("ep"), "n"), "sd-hot-heads")
    later = _dealt_join(rows, earliest, ["h", "w", "w2"], "n", hot, ["d", "p"]).where((F.col("d") != F.col("ed")) | (F.col("p") != F.col("ep")))
    return later.select("d", F.col("p").alias("first"), F.col("p").alias("last"))


def _dealt_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, hot: int, spread: list[str]) -> DataFrame:
    """rows joined to keys on equal columns ``on``; keys has each key once, and in n how many rows it meets.

    Keys with more than hot rows are dealt over ceil(n / hot) salts, by a hash of the rows'
    columns ``spread``, so that no key meets in one task.  Such keys are at most (all rows /
    hot) and known by count: they are broadcast, to tell their rows which salts there are.
    """
    salts = F.when(F.col(n) > hot, F.ceil(F.col(n) / hot).cast("int")).otherwise(1)
    wide = F.broadcast(keys.where(F.col(n) > hot).select(*[F.col(c).alias(f"wide_{c}") for c in on], salts.alias("salts")))
    same = lambda p: [F.col(c) == F.col(f"{p}_{c}") for c in on]
    rows = rows.join(wide, same("wide"), "left").withColumn("salt", F.pmod(F.xxhash64(*spread), F.coalesce("salts", F.lit(1)))).drop("salts", *[f"wide_{c}" for c in on])
    keys = keys.select(*[F.col(c).alias(f"key_{c}") if c in on else F.col(c) for c in keys.columns], F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))).alias("key_salt"))
    return rows.join(keys, [*same("key"), F.col("salt") == F.col("key_salt")]).drop("salt", "key_salt", *[f"key_{c}" for c in on])


def repeated_runs(texts: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK) -> DataFrame:
    """(d, first, last): runs of window starts of texts(d, text), d unique, that also start earlier."""
    rows = _anchor_rows(texts, length, k)
    often = materialize(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "sd-often")
    # so that at most 1 / HOT_SHARE keys are hot
    hot = max(HOT_ROWS, int(HOT_SHARE * (often.agg(F.sum("m")).collect()[0][0] or 0)))
    hits = materialize(_dealt_join(rows, often, ["h"], "m", hot, ["d", "first"]).select("h", "ctx", "ctx2", "d", "first", "last"), "sd-hits")
    heads = hits.groupBy("h", "ctx", "ctx2").agg(F.min(F.struct("d", "first", "last")).alias("e"), F.count("*").alias("n"))
    heads = materialize(heads.select("h", "ctx", "ctx2", F.col("e.d").alias("ed"), F.col("e.first").alias("ef"), F.col("e.last").alias("el"), "n"), "sd-heads")
    again = heads.where("n > 1").drop("el")
    whole = _dealt_join(hits, again, ["h", "ctx", "ctx2"], "n", hot, ["d", "first"]).where((F.col("d") != F.col("ed")) | (F.col("first") != F.col("ef"))).select("d", "first", "last")
    kinds = materialize(heads.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").withColumn("hot", F.col("c") > block), "sd-kinds")
    places = heads.select("h", F.col("ed").alias("d"), F.col("ef").alias("first"), F.col("el").alias("last"))
    wanted = _dealt_join(places, kinds, ["h"], "c", hot, ["d", "first"]).select("d", "h", "first", "last", "hot")
    contexts = materialize(_contexts(texts, wanted, length), "sd-contexts")
    parts = [whole, _sorted_blocks(contexts.where("not hot"), length)]
    if not contexts.where("hot").isEmpty():
        parts.append(_hashed_windows(contexts.where("hot"), length, hot))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(_others(docs))]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*rest, F.lit(0).alias("pad")).alias("rest"))


def covered(docs: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): rows(d, doc_id, text, rest), and per d with anything to remove: whole, runs.

    d is doc_id where ids are unique and not null; else rows get an order-keeping number.
    """
    ship(docs.sparkSession)
    base = _keyed(docs)
    digests = materialize(base.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.octet_length("text").alias("n")), "sd-digests")
    ids = digests.agg(F.count("*").alias("n"), F.count("doc_id").alias("k"), F.count_distinct("doc_id").alias("u")).collect()[0]
    if ids["n"] == ids["u"]:
        rows = base.select(F.col("doc_id").alias("d"), "doc_id", "text", "rest")
        keyed = digests.select(F.col("doc_id").alias("d"), "digest", "n")
    else:
        rows = base.withColumn("digest", F.md5(F.encode("text", "UTF-8"))).orderBy(F.col("doc_id").asc_nulls_first(), "digest").withColumn("d", F.monotonically_increasing_id())
        rows = materialize(rows, "sd-rows")
        keyed = rows.select("d", "digest", F.octet_length("text").alias("n"), "doc_id")
        # rows that repeat id and text are one document: they share the mark of the first
        first = keyed.groupBy("doc_id", "digest").agg(F.min("d").alias("f"))
        rows = materialize(rows.alias("r").join(first.select(F.col("doc_id").alias("fi"), F.col("digest").alias("fd"), "f"), F.col("doc_id").eqNullSafe(F.col("fi")) & (F.col("digest") == F.col("fd"))).select(F.col("f").alias("d"), "doc_id", "text", "rest"), "sd-rows")
        keyed = keyed.groupBy("doc_id", "digest").agg(F.min("d").alias("d"), F.first("n").alias("n")).select("d", "digest", "n")
    # one row per class of copies, folded on the map side
    classes = keyed.where(F.col("n") >= length).groupBy("digest").agg(F.min("d").alias("head"), F.count("*").alias("m")).where("m > 1").select(F.col("digest").alias("cd"), "head")
    copies = materialize(keyed.join(classes, F.col("digest") == F.col("cd")).where(F.col("d") != F.col("head")).select(F.col("d").alias("copy")), "sd-copies")
    texts = rows.select("d", "text").where(F.octet_length("text") >= length).join(_small(copies), F.col("d") == F.col("copy"), "left_anti")
    if ids["n"] != ids["u"]:
        texts = texts.dropDuplicates(["d"])
    runs = repeated_runs(texts, length, k, block)
    marks = runs.groupBy("d").agg(F.collect_list(F.struct("first", "last")).alias("runs")).select("d", F.lit(False).alias("whole"), "runs")
    none = F.array().cast("array<struct<first:int,last:int>>")
    marks = materialize(marks.unionByName(copies.select(F.col("copy").alias("d"), F.lit(True).alias("whole"), none.alias("runs"))), "sd-marks")
    return rows, marks


def removed_mask(n: int, whole: bool, runs: list, length: int) -> np.ndarray:
    """Which of n bytes go."""
    if whole:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int64)
    for r in runs or ():
        edge[r["first"]] += 1
        edge[r["last"] + length] -= 1
    return np.cumsum(edge)[:n] > 0


def _marked(docs: DataFrame, length: int, k: int, block: int) -> DataFrame:
    rows, marks = covered(docs, length, k, block)
    return rows.join(marks.withColumnRenamed("d", "md"), F.col("d") == F.col("md"), "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "runs", "rest")


def report(docs: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    j = _marked(docs, length, k, block).drop("rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, whole, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = t.encode()
                if not whole and not runs:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                gone = removed_mask(len(data), whole, runs, length)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return j.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def keep_text(data: bytes, gone: np.ndarray) -> str:
    """The text without the removed bytes; characters cut in part stay whole."""
    cont = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80
    start = np.cumsum(~cont) - 1
    whole = np.ones(start[-1] + 1 if len(start) else 0, bool)
    np.logical_and.at(whole, start, gone)
    return np.frombuffer(data, np.uint8)[~whole[start]].tobytes().decode() if len(start) else ""


def strip(docs: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, with the repeated bytes removed from text; n_chars, where it is there, follows."""
    j = _marked(docs, length, k, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, whole, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not whole and not runs:
                    out.append(t)
                else:
                    data = t.encode()
                    out.append(keep_text(data, removed_mask(len(data), whole, runs, length)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(4)], names=["doc_id", "text", "rest"])

    done = j.mapInArrow(run, f"doc_id bigint, text string, rest {j.schema['rest'].dataType.simpleString()}")
    fields = {c: F.col("rest").getField(f"c{i}") for i, c in enumerate(_others(docs))}
    if "n_chars" in fields:
        fields["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[F.col(c) if c in ("doc_id", "text") else fields[c].alias(c) for c in docs.columns])


#: op8_suffix_dedup in DuckDB: all windows of 100 bytes, those that also start earlier, and what they cover.
ORACLE = r"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, b[p + 1:p + 100] AS s FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS p FROM t)),
f AS (SELECT s, min({'d': doc_id, 'p': p}) AS f FROM w GROUP BY 1 HAVING count(*) > 1),
l AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE f.d <> doc_id OR f.p <> p),
o AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM l)),
g AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM o GROUP BY doc_id, run),
k AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS z, hi - lo AS gone FROM g
      UNION ALL SELECT doc_id, coalesce(max(hi), 0), octet_length(any_value(b)), NULL FROM t LEFT JOIN g USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(any_value(b)) AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, count(gone) AS n_spans, sha256(unhex(string_agg(hex(b[a + 1:z]), '' ORDER BY z, a))) AS kept_sha256
FROM k JOIN t USING (doc_id) GROUP BY doc_id
"""
