"""Joins, models over folds, memo, archives and sinks against direct computations."""

import random
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linefold import memo
from linefold.operators import contain, folds, logistic, model, nearest, spans
from linefold.plans import study
from linefold.sources import sinks, xml, zipped

# ---- nested spans


def nested(rng, lo, hi, depth=0):
    """A random laminar family inside [lo, hi), equal and touching spans among it."""
    out = []
    while lo < hi and rng.random() < 0.85:
        a = rng.randint(lo, hi - 1)
        b = rng.randint(a + 1, hi)
        out.append((a, b))
        if depth < 6:
            out += nested(rng, a, b, depth + 1)
        lo = b
    return out


def test_enclosing_spans_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for grp in range(12):
        found = nested(rng, 0, 400 if grp == 3 else 40)
        rows += [(grp, i, a, b, f"t{a}") for i, (a, b) in enumerate(found)]
    df = spark.createDataFrame(rows, "grp int, id bigint, lo bigint, hi bigint, tag string").repartition(5)
    inside = lambda x, y: x[0] == y[0] and y[2] <= x[2] and x[3] <= y[3] and (x[2:4] != y[2:4] or y[1] < x[1]) and x[1] != y[1]
    want = {(x[0], x[1], y[1], y[4]) for x in rows for y in rows if inside(x, y)}
    got = spans.enclosing(df, carry=("tag",)).collect()
    assert len(got) == len(want) > 100 and {(r.grp, r.id, r.around, r.around_tag) for r in got} == want
    depth = {(x[0], x[1]): sum(inside(x, y) for y in rows) for x in rows}
    assert {(r.grp, r.id): r.depth for r in spans.depths(df).collect()} == depth
    parents = spans.enclosing(df, parents_only=True).collect()
    assert len(parents) == sum(d > 0 for d in depth.values())
    assert all(r.around_depth == r.depth - 1 == depth[r.grp, r.around] and (r.grp, r.id, r.around) in {w[:3] for w in want} for r in parents)
    assert spans.crossing(df).count() == 0


def test_crossing_spans_are_told(spark):
    s = lambda *rows: spark.createDataFrame(rows, "grp int, id bigint, lo bigint, hi bigint")
    assert spans.crossing(s((1, 1, 0, 5), (1, 2, 3, 8), (2, 3, 0, 5))).count() > 0
    assert spans.crossing(s((1, 1, 0, 5), (1, 2, 5, 8), (2, 3, 0, 5), (2, 4, 0, 5))).count() == 0
    empty = s((1, 1, 0, 5)).where("false")
    assert spans.enclosing(empty).count() == spans.crossing(empty).count() == 0


def test_one_group_is_many_parts(spark):
    """A group with all rows is sorted over several parts, and spans find what earlier parts opened."""
    rows = spark.range(3000).select(F.lit(1).alias("grp"), F.col("id").alias("id"), (F.col("id") + 1).alias("lo"), (F.col("id") + 2).alias("hi")).unionByName(spark.createDataFrame([(1, -1, 0, 5000)], "grp int, id bigint, lo bigint, hi bigint"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spans.events(rows).select("sort_part").distinct().count() > 2
        assert {(r.around, r.n) for r in spans.enclosing(rows).groupBy("around").agg(F.count("*").alias("n")).collect()} == {(-1, 3000)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- logistic regression


def newton(x, y, c=1.0):
    """Weights and free intercept of the balanced objective, solved directly."""
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    x1 = np.hstack([x, np.ones((n, 1))])
    reg = np.full(x1.shape[1], 1 / c)
    reg[-1] = 0
    beta = np.zeros(x1.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x1 @ beta)))
        step = np.linalg.solve((x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(reg), x1.T @ (w * (p - y)) + reg * beta)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta


@pytest.mark.parametrize("with_dense", [False, True])
def test_all_folds_at_once_equal_direct_solutions(spark, with_dense):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for rep in ("a", "b"):
        for fold in range(3):
            n, width = 50, 30
            x = rng.random((n, width)) * (rng.random((n, width)) < 0.3)
            d = rng.normal(5, 3, (n, 4))
            d[:, 3] = 7.0  # a constant feature
            y = (x[:, 0] + d[:, 0] / 10 + rng.normal(0, 0.3, n) > 0.6).astype(float)
            test = np.arange(n) % 3 == fold
            if rep == "b" and fold == 2:
                y[~test] = 1  # one class
            z = x
            if with_dense:
                m, s = d[~test].mean(axis=0), d[~test].std(axis=0)
                z = np.hstack([(d - m) / np.where(s > 0, s, 1), x])
            if y[~test].min() < y[~test].max():
                b = newton(z[~test], y[~test])
                p = 1 / (1 + np.exp(-(z @ b[:-1] + b[-1])))
            else:
                p = np.ones(n)
            want |= {(rep, 0, fold, i): p[i] for i in np.flatnonzero(test)}
            for i in range(n):
                at = np.flatnonzero(x[i])
                rows.append((rep, 0, fold, i, int(y[i]), bool(test[i]), at.tolist(), x[i, at].tolist(), d[i].tolist()))
    df = spark.createDataFrame(rows, "rep string, repeat bigint, fold bigint, doc bigint, label int, test boolean, at array<int>, weights array<double>, dense array<double>").repartition(4)
    df = df if with_dense else df.drop("dense")
    for most in (1_000_000, 40):  # all folds together, and one after another
        got = {(r.rep, r.repeat, r.fold, r.row_id): r.score for r in logistic.sparse_scores(df, most_weights=most).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_shared_rows_score_like_rows_of_each_fold(spark):
    """One row per text for all folds gives the scores that a row per text and fold gives."""
    rng = np.random.default_rng(4)
    terms = spark.createDataFrame([(k, f"t{t}", int(rng.integers(1, 4))) for k in range(90) for t in rng.choice(60, 12, False).tolist()] + [(90, "alone", 1)], "doc bigint, tok string, tf bigint")
    # two repeats; row 90 has no known term, row 91 none at all; in repeat 1 most labels are 1
    label = lambda k, r: int(k % 3 == 0) if r == 0 else int((k * 7) % 3 != 0 or k % 2 == 0)
    dealt = spark.createDataFrame([(k, r, (k * 7) % 4, label(k, r)) for k in range(92) for r in range(2)], "doc bigint, repeat bigint, fold bigint, label int")
    want = logistic.sparse_scores(model.train_fit_tfidf(terms, dealt, size=40).withColumn("rep", F.lit("x")))
    want = {(r.repeat, r.fold, r.row_id): (r.label, r.score) for r in want.collect()}
    got = {(r.repeat, r.fold, r.row_id): (r.label, r.score) for r in logistic.shared_scores(*model.train_fit_counts(terms, dealt, size=40)).collect()}
    assert got.keys() == want.keys() and len(got) == 184
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_few_passes_where_curvatures_differ():
    """Every step is a pass over all rows: with too few remembered moves the limit of steps comes before the optimum."""
    curve = np.logspace(0, 3, 120)  # 321 steps with 8 remembered moves
    passes = []

    def once(live, trials):
        passes.append(len(live))
        return {i: np.append(curve * (w - 1), (curve * (w - 1) ** 2).sum() / 2) for i, w in enumerate(trials)}

    x = logistic._descend(np.array([True, False, True]), 120, once, 1e9, 1e-6, 300)
    assert np.allclose(x[[0, 2]], 1, atol=1e-6) and (x[1] == 0).all() and len(passes) < 250
    assert logistic.remembered(10_000) == 150 and logistic.remembered(1_000_000) == 8


def test_folds_without_rows_or_features(spark):
    schema = "rep string, repeat bigint, fold bigint, doc bigint, label int, test boolean, at array<int>, weights array<double>"
    assert logistic.sparse_scores(spark.createDataFrame([], schema)).collect() == []
    rows = [("a", 0, 0, 1, 1, True, [], []), ("a", 0, 1, 1, 1, False, [], []), ("a", 0, 1, 2, 0, False, [], []), ("a", 0, 1, 3, 0, True, [], [])]
    got = {(r.fold, r.row_id): r.score for r in logistic.sparse_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, 1): 0.5, (1, 3): pytest.approx(0.5)}


def test_f1_and_average_precision_per_fold(spark):
    rng = np.random.default_rng(6)
    rows = [("r", 0, f, 10 * f + i, int(rng.random() < 0.4), float(np.round(rng.random(), 1))) for f in range(4) for i in range(10)]
    got = {r.fold: r for r in study.per_fold(spark.createDataFrame(rows, "rep string, repeat bigint, fold bigint, row_id bigint, label int, score double")).collect()}
    for f in range(4):
        own = sorted((r for r in rows if r[2] == f), key=lambda r: (-r[5], r[3]))
        hits = [k for k, r in enumerate(own, 1) if r[4]]
        tp, said, pos = sum(r[4] for r in own if r[5] >= 0.5), sum(r[5] >= 0.5 for r in own), len(hits)
        assert got[f].n == 10 and got[f].n_pos == pos
        assert got[f].ap == pytest.approx(sum(j / k for j, k in enumerate(hits, 1)) / pos)
        assert got[f].f1 == pytest.approx(2 * tp / (said + pos))


# ---- nearest signatures


def brute_overlap(q, s, jaccard):
    out = {}
    for i, a in q:
        best = (0.0, 0)
        for k, b in sorted(s):
            c = len(set(a) & set(b))
            best = max(best, (c / (len(set(a) | set(b)) if jaccard else len(b)), -k)) if c else best
        if a:
            out[i] = (-best[1] if best[0] else None, best[0])
    return out


@pytest.mark.parametrize("jaccard", [False, True])
def test_nearest_by_overlap_against_all_pairs(spark, jaccard):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    draw = lambda n: sorted({str(w) for w in rng.choice(words, n, p=weights / weights.sum())})
    q = [(k, [*draw(int(rng.integers(1, 25))), "hot"]) for k in range(120)] + [(900, []), (901, ["none"]), (902, ["hot"]), (903, ["hot", "x", "y"])]
    s = [(k, [*draw(int(rng.integers(1, 18))), "hot"]) for k in range(90)] + [(500, []), (501, ["other"])] + [(600 + k, q[k][1]) for k in range(5)]
    qs, ss = spark.createDataFrame(q, "q bigint, feats array<string>"), spark.createDataFrame(s, "s bigint, feats array<string>")
    got = {r.q: (r.s, r.score) for r in nearest.by_overlap(qs, ss, jaccard).collect()}
    want = brute_overlap(q, [x for x in s if x[1]], jaccard)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    none = nearest.by_overlap(qs, ss.where("false"), jaccard).collect()
    assert len(none) == len(want) and {(r.s, r.score) for r in none} == {(None, 0.0)}
    assert nearest.by_overlap(qs.where("false"), ss, jaccard).collect() == []


def test_a_feature_that_all_hold_makes_no_pairs(spark):
    """300 x 300 sets share a word; each query has a match of its own, so the word joins nothing."""
    rows = spark.range(300).select("id", F.array(F.lit("hot"), *[F.concat(F.lit(f"{c}"), F.col("id").cast("string")) for c in "abcd"]).alias("feats"))
    out = nearest.by_overlap(rows.select(F.col("id").alias("q"), "feats"), rows.select(F.col("id").alias("s"), "feats"))
    plan_rows = []
    real = nearest._best

    def watched(scored):
        plan_rows.append(scored.count())
        return real(scored)

    nearest._best = watched
    try:
        assert nearest.by_overlap(rows.select(F.col("id").alias("q"), "feats"), rows.select(F.col("id").alias("s"), "feats")).where("q = s").count() == 300
    finally:
        nearest._best = real
    assert plan_rows == [300] and out.where("score = 1").count() == 300


def test_nearest_by_angle_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 1, (20, 6))
    x = [(k, (centers[k % 20] + rng.normal(0, 0.1, 6)).tolist()) for k in range(400)]
    x += [(1000 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for k in range(200)]  # copies
    x += [(2000, [0.0] * 6), (2001, [0.0] * 6), (2002, None)]
    b = spark.createDataFrame(x, "s bigint, v array<double>").repartition(3)
    m = {k: np.array(v) for k, v in x if v is not None}
    norm = {k: v / (np.linalg.norm(v) or 1) for k, v in m.items()}
    asked = [k for k in m if k % 7 == 0 or k >= 1990]
    want = {}
    for k in asked:
        sims = {j: round(float(norm[k] @ norm[j]), 9) for j in m if j != k}
        want[k] = max((v, -j) for j, v in sims.items())
    for rows in (4096, 50):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", rows)
        got = {r.q: r for r in nearest.by_angle(b.where("s % 7 = 0 or s >= 1990").withColumnRenamed("s", "q"), b).collect()}
        assert got.keys() == want.keys()
        assert all((r.score, -r.s) == (pytest.approx(want[k][0], abs=1e-8), want[k][1]) for k, r in got.items())
    # most pairs of clustered vectors are never looked at
    assert sum(r.compared for r in got.values()) < 0.5 * len(got) * len(m)
    assert nearest.by_angle(b.where("false").withColumnRenamed("s", "q"), b).collect() == []
    assert nearest.by_angle(b.withColumnRenamed("s", "q"), b.where("s = 2000")).count() == len(m) - 1


# ---- group folds


def test_group_folds_of_a_long_tail(spark):
    """A million groups and some heavy ones: none split, and the stated bound holds."""
    tail = spark.range(1_000_000).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), 1 + F.col("id") % 3)).alias("k")).select("g", (F.pmod(F.xxhash64("g", "k"), F.lit(4)) == 0).cast("int").alias("y"))
    large = spark.range(40).select((F.col("id") + 5_000_000).alias("g"), F.explode(F.sequence(F.lit(1), F.lit(5000) + F.col("id") * 250)).alias("k")).select("g", (F.col("k") % (2 + F.col("g") % 5) == 0).cast("int").alias("y"))
    f = folds.stratified_group_folds(tail.unionByName(large), "g", "y")
    per = f.groupBy("g").agg(F.count_distinct("fold").alias("n"), F.first("fold").alias("fold"), F.count("*").alias("rows"), F.sum("y").alias("pos"))
    got = per.groupBy((F.col("rows") > 3).alias("large"), "fold").agg(F.max("n").alias("n"), F.sum("rows").alias("rows"), F.sum("pos").alias("pos")).collect()
    assert max(r.n for r in got) == 1
    light = [r for r in got if not r.large]
    spread = lambda rs, c: max(r[c] for r in rs) - min(r[c] for r in rs)
    assert len(light) == 5 and spread(light, "rows") <= 3 and spread(light, "pos") <= 1 + 2 + 3
    whole = {}
    for r in got:
        a = whole.setdefault(r.fold, [0, 0])
        a[0] += r.rows
        a[1] += r.pos
    assert max(v[0] for v in whole.values()) < 1.02 * min(v[0] for v in whole.values()) and max(v[1] for v in whole.values()) < 1.03 * min(v[1] for v in whole.values())


def test_group_folds_with_null_group_and_few_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 0), ("a", 1), ("b", None), ("c", 0)], "g string, y int")
    f = folds.stratified_group_folds(rows, "g", "y", n=3).collect()
    assert len(f) == 5 and len({r.fold for r in f if r.g is None}) == 1
    assert folds.stratified_group_folds(rows.where("false"), "g", "y").collect() == []


# ---- containment of names


def test_containment_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    needles = ["", None, "a", "b", *{word(rng.randint(1, 9)) for _ in range(60)}]
    hay = ["", None, *{word(rng.randint(1, 14)) for _ in range(80)}, "zz"]
    got = contain.contained(spark.createDataFrame([(x,) for x in needles * 2], "needle string"), spark.createDataFrame([(x,) for x in hay * 2], "name string")).collect()
    want = {(x, y) for x in needles for y in hay if x and y and x in y}
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def test_resolve_counts_both_directions(spark):
    e = spark.createDataFrame([(1, "Big-Vul"), (2, "big vul extended"), (3, "bigvul"), (4, "Vul"), (5, ""), (6, None)], "pos bigint, name string")
    k = spark.createDataFrame([("BIGVUL",), ("x",), ("",), (None,), ("my big vul",)], "key string")
    got = {r.key: tuple(r)[1:] for r in contain.resolve(e, k).collect()}
    assert got == {"BIGVUL": (2, 1, 1, 1), "x": (0, 1, 0, 2), "": (0, 0, 0, None), None: (0, 0, 0, None), "my big vul": (0, 0, 3, 1)}


# ---- memo


def test_memo_computes_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def upper(texts):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64())], names=[memo.DIGEST, "n"])

        return texts.mapInArrow(run, f"{memo.DIGEST} binary, n bigint")

    t = lambda *rows: spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id bigint, text string")
    m = memo.Memo(spark, str(tmp_path / "memo"), memo.version_of(upper, "v1"), "n bigint")
    first = m.apply(t("a", "bb", "a", None, ""), F.col("text"), upper)
    assert sorted((r.id, r.n) for r in first.collect()) == [(0, 1), (1, 2), (2, 1), (3, None), (4, 0)] and seen.value == 3
    second = memo.Memo(spark, str(tmp_path / "memo"), memo.version_of(upper, "v1"), "n bigint").apply(t("bb", "ccc", "ccc"), F.col("text"), upper)
    assert sorted((r.id, r.n) for r in second.collect()) == [(0, 2), (1, 3), (2, 3)] and seen.value == 4
    memo.Memo(spark, str(tmp_path / "memo"), memo.version_of(upper, "v2"), "n bigint").apply(t("a"), F.col("text"), upper).collect()
    assert seen.value == 5  # another version is another table
    # the fault of the former cache by name: a filtered table has its own result
    docs = t(*[f"text {i % 50}" for i in range(200)])
    count = lambda d: m.apply(d, F.col("text"), upper).count()
    assert (count(docs), count(docs.where("id < 10"))) == (200, 10) and seen.value == 55


# ---- archives by byte ranges


def test_archive_members_are_split_and_bounded(spark, tmp_path):
    rng = np.random.default_rng(1)
    big, text = rng.integers(0, 256, 3_000_000, dtype=np.uint8).tobytes(), ("line é %d\n" * 20_000 % tuple(range(20_000))).encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stored.bin", big, zipfile.ZIP_STORED)
        for name, kind in (("deflate", zipfile.ZIP_DEFLATED), ("bz2", zipfile.ZIP_BZIP2), ("lzma", zipfile.ZIP_LZMA)):
            z.writestr(f"{name}.txt", text, kind)
        z.writestr("zeros.bin", bytes(5_000_000), zipfile.ZIP_DEFLATED)
        z.writestr("empty.txt", b"")
        z.writestr("../out.txt", b"x")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        t.add(tmp_path / "a.zip", "inner/a.bin")
    damaged = bytearray((tmp_path / "a.zip").read_bytes())
    damaged[1000] ^= 255
    (tmp_path / "c.zip").write_bytes(bytes(damaged))
    with tarfile.open(tmp_path / "d.tgz", "w:gz") as t:
        t.add(tmp_path / "a.zip", "a.bin")
    chunks = zipped.read_chunks(spark, str(tmp_path), chunk_bytes=100_000, split_bytes=500_000)
    rows = chunks.withColumn("task", F.spark_partition_id()).collect()
    whole = {}
    for r in sorted((r for r in rows if r.error is None), key=lambda r: (r.archive, r.member, r.chunk)):
        key = r.archive.rsplit("/", 1)[-1], r.member
        assert r.offset == r.chunk * 100_000 == len(whole.get(key, b"")) and len(r.data) <= 100_000
        whole[key] = whole.get(key, b"") + bytes(r.data)
    assert whole["a.zip", "stored.bin"] == big and whole["a.zip", "zeros.bin"] == bytes(5_000_000) and whole["a.zip", "empty.txt"] == b""
    assert all(whole["a.zip", f"{k}.txt"] == text for k in ("deflate", "bz2", "lzma"))
    assert whole["b.tar", "inner/a.bin"] == whole["d.tgz", "a.bin"] == (tmp_path / "a.zip").read_bytes()
    assert len({r.task for r in rows if r.archive.endswith("a.zip") and r.member == "stored.bin"}) == 6
    assert {(r.archive[-5:], r.member) for r in rows if r.error} == {("a.zip", "../out.txt"), ("c.zip", "../out.txt")}  # a split member has no checksum to compare
    whole_c = zipped.read_chunks(spark, str(tmp_path / "c.zip"), wanted=("stored.bin",), chunk_bytes=1 << 20, split_bytes=1 << 23).collect()
    assert [bool(r.error) for r in whole_c].count(True) == 1
    lines = zipped.read_lines(zipped.read_chunks(spark, str(tmp_path / "a.zip"), wanted=("*.txt",), chunk_bytes=1000, split_bytes=4000))
    got = [r.line for r in lines.where("member = 'bz2.txt'").orderBy("chunk", "line_idx").collect()]
    assert got == text.decode().splitlines()


@pytest.mark.parametrize("data, want", [(b"", []), (b"\n", [""]), (b"a", ["a"]), (b"a\n\nbb", ["a", "", "bb"]), (b"\n\nabcdefgh\n\n", ["", "", "abcdefgh", ""]), ("ä\nöü\n".encode(), ["ä", "öü"])])
@pytest.mark.parametrize("size", [1, 3, 100])
def test_lines_across_chunks(spark, tmp_path, data, want, size):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("t.txt", data)
    got = zipped.read_lines(zipped.read_chunks(spark, str(tmp_path), chunk_bytes=size, split_bytes=2 * size)).orderBy("chunk", "line_idx").collect()
    assert [r.line for r in got] == want


# ---- result documents


def test_result_documents_are_nested_json(spark, tmp_path):
    rows = [(f"p{i % 7}", f"t{i % 11}", i, {"k": [float(i), float("nan")]}) for i in range(77)]
    df = spark.createDataFrame(rows, "project string, tool string, n int, m map<string,array<double>>").repartition(5)
    at = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_result(spark, at, {"scores": (df, ("project", "tool")), "flat": (df.select("tool", "project", "n"), ("tool", "project")), "rows": df.select("n").orderBy("n"), "none": df.where("false"), "no_keys": (df.where("false"), ("project", "tool")), "note": {"s": {3, 1}, "x": float("inf")}})
        assert len([p for p in (tmp_path / "out").iterdir() if "-1-" in p.name]) > 6  # many tasks wrote it
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sinks.read_document(at)
    assert got["scores"] == {p: {t: {"n": n, "m": {"k": [float(n), None]}} for q, t, n, _ in rows if q == p} for p in {r[0] for r in rows}}
    assert got["flat"]["t3"] == {p: n for p, t, n, _ in rows if t == "t3"} and [r["n"] for r in got["rows"]] == list(range(77))
    assert (got["none"], got["no_keys"], got["note"]) == ([], {}, {"s": [1, 3], "x": None})
    sinks.write_result(spark, at, {"a": 1})  # the new document takes the old one's place
    assert sinks.read_document(at) == {"a": 1} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failed_task_leaves_no_output(spark, tmp_path):
    at = str(tmp_path / "out")
    sinks.write_result(spark, at, {"a": 1})
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="no"):
        sinks.write_result(spark, at, {"good": spark.range(3), "bad": bad})
    assert sinks.read_document(at) == {"a": 1} and [p.name for p in tmp_path.iterdir()] == ["out"]


# ---- XML


def test_one_xml_file_is_read_by_many_tasks(spark, tmp_path):
    at = str(tmp_path / "u")
    df = spark.range(20_000).select(F.col("id").alias("_id"), F.array(F.struct(F.col("id").alias("_line"), F.lit("a < b & c").alias("_VALUE"))).alias("statement"))
    xml.write_units(df.coalesce(1), at)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        read = xml.read_units(spark, at, "_id long, statement array<struct<_line: long, _VALUE: string>>")
        assert read.rdd.getNumPartitions() > 4
        r = read.agg(F.count("*").alias("n"), F.sum("_id").alias("s"), F.min(F.col("statement")[0]["_VALUE"]).alias("v"), F.count_distinct("_id").alias("d")).collect()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(r) == (20_000, 20_000 * 19_999 // 2, "a < b & c", 20_000)


def test_broken_units_are_told(spark, tmp_path):
    (tmp_path / "u.xml").write_text('<units>\n<unit id="1"><a>x</a></unit><unit id="2"><a>y</b></unit>\n<unit\nid="3"><a>z\nz</a></unit><units2/></units>')
    got = xml.read_units(spark, str(tmp_path), "_id long, a string", keep_broken=True).collect()
    assert sorted((r._id, r.a) for r in got if r._corrupt_record is None) == [(1, "x"), (3, "z\nz")] and sum(r._corrupt_record is not None for r in got) == 1
    assert xml.read_units(spark, str(tmp_path), "_id long, a string").count() == 2
