"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: t bins; in round i each element is thrown into one bin, and a bin keeps the
smallest value of the first round that reaches it.  After t rounds of random bins, round
t + j throws every element into bin j, so every coordinate fills.  Agreement of a
coordinate has probability equal to the Jaccard similarity, with the concentration of
independent MinHash.

Documents with equal sets form a class first, so copies cost one row each.  Classes whose
sketches agree in a whole band meet in a bucket.  A bucket links its members to its smallest
one (a star, never all pairs); links are confirmed on the full sets.

A hub that fails to link must not hide a link between others.  One bit of each coordinate
(BITS of them) estimates similarity within 0.03.  Members that are loosely similar to a hub
(0.4 by the bits) join its cluster; members that are not closely similar to it (0.6) get
hubs of their own, so two members that link always share a cluster, by the triangle
inequality of the Jaccard distance; closely similar ones (LINK) are confirmed like stars.
Inside a cluster, documents of different components are compared in blocks on their full
sets, and only links leave a block; the cluster's largest component is compared with the
others, never with itself.  No cap is set on buckets, clusters or partners.

bands x rows: the chance to miss a pair at the threshold is (1 - threshold^rows)^bands,
about 2e-8 with 76 x 7 at 0.8.

Defined cases: null or empty text has no shingles and is its own component; rows that
repeat a doc_id with one text share their component; null ids: the component's id is the
smallest non-null one, or null; ties do not arise (ids order classes); an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from .components import components_of, connected_components
from .wordhash import U, mix, shingle_sets

BANDS, ROWS = 76, 7
BITS = 512
#: Differing bits: at 0.4, plus six deviations; at 0.6; at the threshold 0.8, plus six deviations.
LOOSE, CLOSE, LINK = 216, 102, 92
#: Shingles of a block of a cluster: a twelfth of the cluster, within these bounds.
BLOCK_ITEMS = (40_000, 400_000)
BROADCAST_ROWS = 200_000


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit hashes."""
    n = len(elements)
    key = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step, r = max(1, -(-2 * t // n)), 0
    while True:
        rounds = np.arange(r, min(r + step, t), dtype=np.uint64)
        if len(rounds):
            v = mix((elements[None, :] ^ (rounds[:, None] * U(0xA24BAED4963EE407))) + U(0x9FB21C651E98DF25))
            at = ((v >> U(32)) * U(t)) >> U(32)
            # the round first, then 44 bits of the value
            np.minimum.at(key, at.ravel().astype(np.int64), ((rounds[:, None] << U(44)) | (mix(v) >> U(20))).ravel())
        r += len(rounds)
        empty = np.flatnonzero(key == np.iinfo(np.uint64).max)
        if not len(empty):
            return key
        if r >= t:
            # the last t rounds throw everything into one bin each
            tail = (U(t) + empty.astype(np.uint64))[:, None]
            key[empty] = ((tail << U(44)) | (mix(elements[None, :] ^ (tail * U(0xA24BAED4963EE407))) >> U(20))).min(axis=1)
            return key
        step = max(step, -(-t // n))


def band_hashes(key: np.ndarray, bands: int, rows: int) -> np.ndarray:
    k = mix(key).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix(h * U(0xD6E8FEB86659FD93) + k[:, j])
    return h


def sketch_bits(key: np.ndarray) -> np.ndarray:
    """BITS bits of a sketch as 64-bit words."""
    return np.packbits((mix(key[:BITS]) & U(1)).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (128 bits of the set), the band hashes and the sketch bits."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets([(x or "").encode() for x in b.column(1).to_pylist()], k)
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            sketches = [sketch(s, bands * rows) if len(s) else None for s in sets]
            lists = _lists([band_hashes(x, bands, rows).view(np.int64) if x is not None else NONE for x in sketches])
            bits = _lists([sketch_bits(x) if x is not None else NONE for x in sketches])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), lists, bits],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "bits"],
            )

    return src.mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, bits array<bigint>")


NONE = np.zeros(0, np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(values) + 1, np.int32)
    off[1:] = np.cumsum([len(v) for v in values])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values) if values else NONE))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """cid, elements: the full shingle sets, as bytes, of the rows of texts(cid, w1, w2, text) whose set has the key (w1, w2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets([(x or "").encode() for x in b.column(3).to_pylist()], k)
            keep = [i for i, (s, w1, w2) in enumerate(zip(sets, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) if set_key(s) == (w1, w2)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["cid", "elements"])

    return texts.mapInArrow(run, "cid bigint, elements binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("eb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            ea, eb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(ea[i].as_buffer(), np.uint64), np.frombuffer(eb[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                z = np.concatenate([x, y])
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                ok.append(100 * both >= percent * (len(z) - both))
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInArrow(run, "a bigint, b bigint")


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted rows are few; else the plain frame, which joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_links (confirmed links that its class was joined by)."""
    sig = materialize(signatures(docs, k, bands, rows), "mh-sig")
    # one row per distinct set; the aggregation folds copies on the map side
    groups = sig.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = materialize(groups.withColumn("cid", F.monotonically_increasing_id()), "mh-classes")
    words = classes.select("cid", "n", "bands", *[F.col("bits")[i].alias(f"s{i}") for i in range(BITS // 64)])

    # stars: each bucket's members against its smallest; sketches join the few pairs, not all bucket rows
    members = words.select("cid", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("cid").alias("a"), F.count("*").alias("m")).where("m > 1").select(F.col("bucket").alias("h_bucket"), "a")
    rays = materialize(members.join(hubs, F.col("bucket") == F.col("h_bucket")).where("cid <> a").select("bucket", "a", F.col("cid").alias("b")), "mh-rays")
    side = lambda c: words.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.struct(*SKETCH).alias(f"k{c}"))
    pairs = rays.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").withColumn("far", differing("ka", "kb"))
    pairs = materialize(pairs.select("a", "b", "na", "nb", "far"), "mh-pairs")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    stars = pairs.where((F.col("far") <= LINK) & fits).select("a", "b")
    apart = rays.join(pairs.where(F.col("far") > CLOSE).select("a", "b"), ["a", "b"], "left_semi").select("bucket", "b")
    own = materialize(_own_hubs(apart.join(words.select(F.col("cid").alias("b"), *SKETCH), "b")), "mh-hubs")
    stars = stars.unionByName(own.where(F.col("far") <= LINK).select("a", "b")).distinct()
    loose = pairs.where(F.col("far") <= LOOSE).select("a", "b").unionByName(own.select("a", "b"))
    links = materialize(verify(stars, _sets(docs, classes, stars.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), k, "mh-star-sets"), percent), "mh-links")
    cluster, roots = components_of([loose, links])
    # clusters of three or more with several components: a pair alone has been confirmed already
    at = cluster.withColumnRenamed("node", "cid").withColumnRenamed("root", "cluster").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "cluster", F.coalesce("root", "cid").alias("root"))
    open_ = at.groupBy("cluster").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("m > 2 and lo <> hi").select(F.col("cluster").alias("o_cluster"))
    rest = materialize(at.join(open_, F.col("cluster") == F.col("o_cluster"), "left_semi"), "mh-rest")
    if not rest.isEmpty():
        sets = _sets(docs, classes, rest.select("cid"), k, "mh-rest-sets")
        # they join different components, so no link is found again; the stars found so far stand for the links inside them
        across = materialize(_across(rest, words, sets, percent).distinct(), "mh-across")
        if not across.isEmpty():
            links = links.unionByName(across)
            roots = connected_components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))

    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    # only linked classes need their component's smallest id; hubs' ids stay out of the large join
    linked = materialize(roots.join(classes.select("cid", "min_id"), F.col("node") == F.col("cid")).select("node", "root", "min_id"), "mh-linked")
    lowest = linked.groupBy("root").agg(F.min("min_id").alias("component_id"))
    linked = linked.join(_small(lowest), "root").select("node", "component_id").join(degree.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").drop("linked")
    named = classes.join(linked, F.col("cid") == F.col("node"), "left").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.when(F.col("node").isNull(), F.col("min_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
    named = materialize(named, "mh-named")
    rows_ = sig.select("doc_id", "n_shingles", "k1", "k2").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows_.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


SKETCH = [f"s{i}" for i in range(BITS // 64)]


def differing(x: str, y: str) -> Column:
    """Bits in which two sketches (structs of words) differ."""
    return sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH), F.lit(0))


def _sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, k: int, name: str) -> DataFrame:
    """(cid, elements) of some classes, from the texts of their smallest ids."""
    wanted = materialize(classes.join(cids, "cid").select("cid", F.col("k1").alias("w1"), F.col("k2").alias("w2"), "min_id"), "mh-wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("t_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(_small(wanted), F.col("t_id").eqNullSafe(F.col("min_id"))).select("cid", "w1", "w2", "text")
    # where an id stands on several texts, only those of the class's own set pass
    return materialize(sets_of(texts, k).groupBy("cid").agg(F.first("elements").alias("elements")), name)


def _own_hubs(rays: DataFrame) -> DataFrame:
    """Cluster edges (a, b, far) of members that are not close to their bucket's hub.

    Each bucket's rows stream through one task, against hubs that are found on the way;
    a row is close to some hub or becomes one.  Memory is that of the hubs of one bucket.
    """
    n = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rays.select("bucket", "b", *SKETCH).repartition(n, "bucket").sortWithinPartitions("bucket", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, hubs = None, [], np.zeros((0, len(SKETCH)), np.uint64)
        for batch in batches:
            keys, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = np.stack([batch.column(i).to_numpy() for i in range(2, 2 + len(SKETCH))], axis=1).view(np.uint64)
            # runs of one row in a new bucket can have no partner here
            alone = np.concatenate([keys[1:] != keys[:-1], [False]]) & np.concatenate([[False], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            out: list[tuple[int, int, int]] = []
            for i in np.flatnonzero(~alone):
                if keys[i] != bucket:
                    bucket, ids, hubs = keys[i], [], np.zeros((0, len(SKETCH)), np.uint64)
                far = np.bitwise_count(hubs ^ bits[i]).sum(axis=1) if ids else np.zeros(0)
                out += [(ids[j], int(own[i]), int(far[j])) for j in np.flatnonzero(far <= LOOSE)]
                if not (far <= CLOSE).any():
                    ids.append(int(own[i]))
                    hubs = np.vstack([hubs, bits[i : i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["a", "b", "far"])

    return dealt.mapInArrow(run, "a bigint, b bigint, far bigint")


def _across(rest: DataFrame, words: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of one cluster in different components, found in blocks.

    rest: (cid, cluster, root).  A document gets at most one link per other component and
    block pair; all pairs whose sketch bits allow the threshold are compared on full sets.
    """
    m = materialize(rest.join(words.select(F.col("cid").alias("w"), "n", *SKETCH), F.col("cid") == F.col("w")).drop("w"), "mh-members")
    # per cluster its largest component, and how many blocks that and the others make
    by_root = m.groupBy("cluster", "root").agg(F.sum("n").alias("s"))
    per = by_root.groupBy("cluster").agg(F.max(F.struct("s", "root")).alias("most"), F.sum("s").alias("total"))
    low, high = BLOCK_ITEMS
    size = F.greatest(F.lit(low), F.least(F.lit(high), F.col("total") / 12))
    blocks_of = lambda items: F.greatest(F.lit(1), F.ceil(items / size)).cast("int")
    # a small cluster is one block
    one = lambda count, n: F.when(F.col("total") <= low, n).otherwise(count)
    per = per.select(F.col("cluster").alias("p_cluster"), F.col("most.root").alias("main"), one(blocks_of(F.col("most.s")), 0).alias("n_main"), one(blocks_of(F.col("total") - F.col("most.s")), 1).alias("n_other"))
    per = _small(materialize(per, "mh-blocks"))
    dealt = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(F.col(n), F.lit(1))).cast("int")
    m = m.join(per, F.col("cluster") == F.col("p_cluster")).withColumn("block", F.when((F.col("n_main") > 0) & (F.col("root") == F.col("main")), F.col("n_other") + dealt("n_main")).otherwise(dealt("n_other")))
    # the other components' blocks with each other and with those of the largest one, which come behind them
    pairs = per.select(F.col("p_cluster").alias("cluster"), F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias("i"), (F.col("n_other") + F.col("n_main") - 1).alias("last"))
    pairs = pairs.select("cluster", "i", F.explode(F.sequence("i", "last")).alias("j"))
    full = m.join(sets, "cid").select("cluster", "block", "cid", "root", "n", *SKETCH, "elements")
    side = lambda c, name: full.join(pairs, (full["cluster"] == pairs["cluster"]) & (full["block"] == pairs[c])).select(full["cluster"], "i", "j", F.lit(name).alias("side"), "cid", "root", "n", *SKETCH, "elements")
    both = side("i", 0).unionByName(side("j", 1).where("i <> j"))

    def block(table: pa.Table) -> pa.Table:
        ids, root, n, where = (table[c].to_numpy() for c in ("cid", "root", "n", "side"))
        bits = np.stack([table[c].to_numpy() for c in SKETCH], axis=1).view(np.uint64)
        elements = [np.frombuffer(e.as_buffer(), np.uint64) for chunk in table["elements"].chunks for e in chunk]
        left = np.flatnonzero(where == 0)
        right = np.flatnonzero(where == 1) if (where == 1).any() else left
        flat = np.concatenate([elements[j] for j in right])
        off = np.concatenate([[0], np.cumsum(n[right])])
        out: list[tuple[int, int]] = []
        for i in left:
            may = (root[right] != root[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * percent)
            may &= np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1) <= LINK
            at = np.flatnonzero(may)
            if not len(at):
                continue
            part = np.concatenate([flat[off[j] : off[j + 1]] for j in at])
            place = np.minimum(np.searchsorted(elements[i], part), len(elements[i]) - 1)
            hit = np.concatenate([[0], np.cumsum(elements[i][place] == part)])
            ends = np.cumsum(n[right[at]])
            both = hit[ends] - hit[ends - n[right[at]]]
            ok = at[100 * both >= percent * (n[i] + n[right[at]] - both)]
            seen = set()
            for j in right[ok]:
                if root[j] not in seen:
                    seen.add(root[j])
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return both.groupBy("cluster", "i", "j").applyInArrow(block, "a bigint, b bigint")


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without the documents that are not kept.

    An id goes if none of its rows is kept; rows that repeat an id and its text stay once;
    rows without an id stay.
    """
    near = near_duplicates(docs, k, percent).select(F.col("doc_id").alias("g_id"), "kept").where("g_id is not null")
    ids = materialize(near.groupBy("g_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "mh-ids")
    out = docs.join(_small(ids.where("not kept")), docs["doc_id"] == F.col("g_id"), "left_anti")
    if ids.where("n > 1").isEmpty():
        return out
    return out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


#: op10_minhash in DuckDB: links by the rarest shingles of each set (a link must share one of them), then components.
ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT g, count(*) AS f FROM s GROUP BY 1),
r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM s JOIN f USING (g) JOIN n USING (doc_id)),
p AS (SELECT * FROM r WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
i AS (SELECT a, b, count(*) AS i FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
m AS (SELECT a AS node, a AS root FROM u UNION SELECT b, root FROM m JOIN u ON a = node),
c1 AS (SELECT node, min(root) AS root FROM m GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c1 ON node = doc_id
"""
