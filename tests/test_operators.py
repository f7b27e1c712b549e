"""Text helpers, metrics, statistics, folds, matching, regions and sources on small cases."""

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linefold.functions import arrays as A
from linefold.functions import metrics as M
from linefold.functions import text as T
from linefold.operators import folds, graph, match, model, regions
from linefold.operators import statistics as S
from linefold.sources import readers
from linefold.streaming import windows


def one(df):
    (r,) = df.collect()
    return r


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f\n", "\n\n"])
def test_lines_are_pythons(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(T.lines(F.col("t")).alias("l"))).l == text.splitlines()


def test_labels_and_strings(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("true",), ("0",), (None,), ("x",)], "v string")
    got = [tuple(r) for r in df.select(T.is_positive(F.col("v")), T.is_positive_text(F.col("v")), T.is_negative(F.col("v"))).collect()]
    assert got == [(True, True, False), (True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, False, False)]
    df = spark.createDataFrame([("\t a b \n", "")], "s string, e string")
    r = one(df.select(T.strip(F.col("s")).alias("s"), T.has_text(F.col("e")).alias("h"), T.group_key(F.col("e"), F.col("s")).alias("g"), T.feature_tokens(F.col("e")).alias("f"), T.simple_name(F.lit("Some-Name 2")).alias("n")))
    assert (r.s, r.h, r.g, r.f, r.n) == ("a b", False, "\t a b \n", ["EMPTYFEAT"], "somename2")


@pytest.mark.parametrize(
    "line,dep,kind",
    [("  ", False, "cosmetic"), ("// x", False, "cosmetic"), ("if (a)", True, "control_structure_change"), ("int a = 1;", False, "declaration_type_change"), ("int a = 1;", True, "outside_dependence_cone"), ("a = 1;", False, "outside_dependence_cone")],
)
def test_miss_kinds(spark, line, dep, kind):
    assert one(spark.range(1).select(T.miss_kind(F.lit(line), F.lit(dep)).alias("k"))).k == kind


def test_insertion_kinds(spark):
    got = [one(spark.range(1).select(T.insertion_kind(F.lit(x)).alias("k"))).k for x in ("if (!p)", "  goto out;", "x = 1;")]
    assert got == ["absent_guard", "error_handling_cleanup", "other_insertion"]


def test_sets_and_empty_rules(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4], [])], "a array<int>, b array<int>, e array<int>")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    r = one(df.select(A.jaccard(a, b), A.jaccard(e, e), A.jaccard(e, e, 1.0), A.containment(a, b), A.containment(e, b), A.coverage(a, b), A.cosine(a, b), A.cosine(e, b), A.region_or_whole(e, F.lit(2)), A.pad_ids(a, 5), A.pad_ids(a, 2)))
    assert [round(x, 6) if isinstance(x, float) else x for x in r] == [0.5, 0.0, 1.0, round(2 / 3, 6), 0.0, round(2 / 3, 6), round(20 / math.sqrt(14 * 29), 6), 0.0, [0, 1], [1, 2, 3, 0, 0], [1, 2]]


def test_features_in_region(spark):
    df = spark.createDataFrame([([(1, "a"), (-1, "b"), (3, "c")], [0, 1])], "f array<struct<line:int,feat:string>>, r array<int>")
    r = one(df.select(A.in_region(F.col("f"), F.col("r")).alias("x"), A.in_region(F.col("f"), None).alias("y"), A.region_text(F.array(F.lit("p"), F.lit("q")), F.col("r")).alias("t")))
    assert [x.feat for x in r.x] == ["a"] and len(r.y) == 3 and r.t == "p\nq"


def test_detector_metrics(spark):
    c = [F.lit(float(x)) for x in (3, 1, 2, 4)]
    r = one(spark.range(1).select(M.precision(c[0], c[1]), M.recall(c[0], c[2]), M.f1(*c[:3]), M.mcc(*c), M.balanced_accuracy(*c), M.f1(*[F.lit(0.0)] * 3), M.mcc(*[F.lit(0.0)] * 4)))
    assert [round(x, 6) for x in r] == [0.75, 0.6, round(6 / 9, 6), round((12 - 2) / math.sqrt(4 * 5 * 5 * 6), 6), 0.7, 0.0, 0.0]
    r = one(spark.range(1).select(M.random_order_ifa(F.lit(9), F.lit(1)), M.random_order_effort(F.lit(9), F.lit(1)), M.random_order_topk(F.lit(4), F.lit(1), 2), M.random_order_topk(F.lit(2), F.lit(2), 3)))
    assert [round(x, 6) for x in r] == [4.0, round(5 / 9, 6), 0.5, 1.0]


def test_wilcoxon_textbook(spark):
    a, b = [125, 115, 130, 140, 140, 115, 140, 125, 140, 135], [110, 122, 125, 120, 140, 124, 123, 137, 135, 145]
    r = one(S.wilcoxon(spark.createDataFrame(list(zip(a, b, strict=True)), "a bigint, b bigint")))
    assert r.n == 9 and r.w == 18.0 and r.z == pytest.approx(-0.5331, abs=1e-3) and r.p == pytest.approx(0.594, abs=2e-3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.lists(st.integers(0, 6), min_size=1, max_size=12))
def test_cliffs_delta_is_pairwise(spark, a, b):
    df = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    want = sum((x > y) - (x < y) for x in a for y in b) / len(a) / len(b)
    assert one(S.cliffs_delta(df(a), df(b))).delta == pytest.approx(want) == pytest.approx(-one(S.cliffs_delta(df(b), df(a))).delta)


def test_spearman_mcnemar_holm(spark):
    r = one(S.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0)], "a double, b double")))
    assert r.rho == pytest.approx(0.8)
    rows = [(True, True)] * 5 + [(True, False)] * 1 + [(False, True)] * 7
    r = one(S.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean")))
    assert (r.n11, r.n10, r.n01, r.n00) == (5, 1, 7, 0) and r.p == pytest.approx(2 * (1 + 8) / 2**8)
    h = {r.name: r.adjusted for r in S.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.9)], "name string, p double")).collect()}
    assert h == {"a": pytest.approx(0.04), "c": pytest.approx(0.09), "b": pytest.approx(0.09), "e": pytest.approx(0.9), "d": None}


def test_corrected_t(spark):
    r = one(S.corrected_t(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "d double"), 0.0))
    assert r.t == pytest.approx(3 / math.sqrt(2.5 / 5)) and r.p == pytest.approx(0.0132, abs=2e-4)
    assert one(S.corrected_t(spark.createDataFrame([(0.0,), (0.0,)], "d double"), 0.25)).p == 1.0
    assert one(S.corrected_t(spark.createDataFrame([(2.0,), (2.0,)], "d double"), 0.25)).p == 0.0
    r = one(S.mean_diff_ci(spark.createDataFrame([(1.0,), (3.0,)], "d double")))
    assert (r.mean, r.hi) == (2.0, pytest.approx(2 + 1.96)) and r.std_pop == 1.0


def test_bootstrap_brackets_the_mean(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(5, 1)) for i in range(60)]
    r = one(S.bootstrap_mean(spark.createDataFrame(rows, "i int, v double"), "v", "i", 300))
    m = sum(v for _, v in rows) / 60
    assert r.lo < m < r.hi and r.hi - r.lo < 1.2


def test_average_precision_and_thresholds(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.7, False), (0.1, False)], "score double, actual boolean")
    assert one(match.average_precision(s)).ap == pytest.approx(0.5 * 1 + 0.5 * 0.5)
    assert one(match.average_precision(s.withColumn("score", F.lit(0.5)))).ap == pytest.approx(0.4)  # prevalence
    b = one(match.best_f1_threshold(s))
    assert (b.threshold, b.f1) == (0.9, pytest.approx(2 / 3))
    sw = match.tau_sweep(s, [0.5, 0.85])
    assert one(match.best_tau(sw)).tau == 0.5
    assert one(match.best_tau(match.tau_sweep(s, [0.05, 0.01]))).tau == 0.01  # the lowest on ties


def test_regions(spark):
    docs = spark.createDataFrame([(1, "a b\nx, a\nq\nr\nb a"), (2, "no sink")], "doc_id bigint, text string")
    lines = regions.explode_lines(docs)
    sink = F.col("line").contains(",")
    got = lambda df: sorted((r.doc_id, r.line_idx) for r in df.collect())
    assert got(regions.mention_region(lines, sink, 1)) == [(1, 0), (1, 1), (1, 4)]
    assert got(regions.mention_region(lines, sink, 1, ("a",))) == [(1, 1)]
    assert got(regions.window_region(lines, sink, 1)) == [(1, 0), (1, 1), (1, 2)]
    near = {(r.doc_id, r.line_idx): r.dist for r in regions.nearest_sink(lines, sink).collect()}
    assert near == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 0): 1}
    c = one(regions.calibrated_window(lines, sink, spark.createDataFrame([(1, 4)], "doc_id bigint, target bigint")))
    assert (c.k, c.win_size) == (2, 4)
    o = regions.nearest_sink(lines, sink).withColumn("in_region", F.col("dist") <= 1)
    for kind in ("top_down", "region_first", "sink_proximity"):
        pos = regions.reading_order(o, kind).where("doc_id = 1").orderBy("pos").collect()
        assert [r.pos for r in pos] == list(range(5)) and sorted(r.line_idx for r in pos) == list(range(5))
    assert [r.line_idx for r in pos] == [1, 0, 2, 3, 4]
    hits = spark.createDataFrame([(1, 3), (1, 0)], "doc_id bigint, line_idx bigint")
    e = one(regions.effort(regions.reading_order(o, "top_down"), hits))
    assert (e.ifa, e.effort, e.top1, e.n_hits) == (0, 0.8, 1, 2)


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "x", "y"), (2, "a", "z")], "grp int, src string, dst string")
    got = {(r.grp, r.node): r.depth for r in regions.closure(edges, spark.createDataFrame([(1, "a")], "grp int, node string")).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2}


def test_graph(spark):
    rng = random.Random(5)
    texts = ["a 1\nb\nc\nd a", "", "one line", "\n".join(" ".join(rng.choice(["x", "y", "zed", "7", "w9"]) for _ in range(rng.randint(0, 3))) for _ in range(95))]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id int, text string")
    head = lambda line: line.rlike("[0-9]")
    rows = {}
    for r in graph.line_graph(docs, head).collect():
        rows.setdefault(r.doc_id, set()).add((r.a, r.b))
    assert rows[0] == {(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)} and set(rows) == {0, 3}
    out = docs.where("text is not null").select("doc_id", graph.around(graph.later(F.col("text"), head)).alias("near"), F.transform(F.slice(T.lines(F.col("text")), 1, 80), lambda x: F.length(x).cast("double")).alias("x"))
    out = {r.doc_id: r for r in out.select("doc_id", "near", graph.weights(F.col("near")).alias("w"), graph.spread(F.col("near"), F.col("x")).alias("y")).collect()}
    for k, t in enumerate(texts):
        lines = t.split("\n")[:80] if t else []
        ids = [set(re.findall(T.IDENT, x)) for x in lines]
        n = len(lines)
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if b == a + 1 or (re.search("[0-9]", lines[a]) and b <= a + 3) or ids[a] & ids[b]}
        assert rows.get(k, set()) == edges
        near = [[b for b in range(n) if a == b or (a, b) in edges or (b, a) in edges] for a in range(n)]
        assert out[k].near == near
        for a in range(n):
            assert out[k].w[a] == pytest.approx([1 / math.sqrt(len(near[a]) * len(near[b])) for b in near[a]])
            assert out[k].y[a] == pytest.approx(sum(len(lines[b]) / math.sqrt(len(near[a]) * len(near[b])) for b in near[a]))


def test_folds(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0), f"g{i % 7}") for i in range(100)], "id int, y int, g string")
    f = folds.stratified_folds(rows, "y", "id").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert [(r.n, r.p) for r in f] == [(20, 5)] * 5
    s = folds.balanced_sample(rows, "y", "id", 50)
    assert s.groupBy("y").count().orderBy("y").collect()[1][1] == 10 and s.count() == 50
    for df in (folds.group_folds(rows, "g"), folds.stratified_group_folds(rows, "g", "y")):
        assert df.groupBy("g").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).collect()[0][0] == 1 and df.count() == 100
    assert folds.repeated_folds(rows, "y", "id", 3).groupBy("id").count().where("count <> 3").count() == 0


def test_tfidf_and_models(spark):
    toks = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "b")], "doc int, pos int, tok string")
    w = {(r.doc, r.tok): r.weight for r in model.tfidf(toks).collect()}
    ia, ib = math.log(3 / 2) + 1, 1.0
    assert w[1, "a"] == pytest.approx(2 * ia / math.hypot(2 * ia, ib)) and w[2, "b"] == 1.0
    v = model.vocabulary(toks, 1)
    assert one(v).tok == "a"
    assert {r.doc: r.ids for r in model.encode_ids(toks, v, 4).collect()} == {1: [2, 2, 1, 0], 2: [1, 0, 0, 0]}


def test_jsonl_and_sources(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_bytes(b'{"func_before": "a", "vul": 1}\n\n  \nnot json\n{"func_before": "b\xff", "vul": "1", "extra": 2}\n{"vul": true}\n')
    rows = readers.read(spark, "jsonl", str(p)).orderBy("row_pos").collect()
    assert [(r.func_before and r.func_before[0], r.vul) for r in rows] == [("a", "1"), ("b", "1"), (None, "true")]
    with pytest.raises(ValueError, match="unknown source type"):
        readers.read(spark, "nope", str(p))
    out = str(tmp_path / "out")
    readers.write_jsonl(spark.createDataFrame([(1, [3, 1, 2])], "id int, s array<int>"), out)
    assert one(spark.read.json(out)).s == [1, 2, 3]
    (tmp_path / "r.json").write_text('{"a": {"b": [1, 2.5]}, "c": "x", "d": true}')
    assert sorted(tuple(r) for r in readers.read(spark, "result", str(tmp_path / "r.json")).collect()) == [("a.b[0]", 1.0), ("a.b[1]", 2.5)]
    (tmp_path / "s.json").write_text('{"file": "x/f.c", "method": "m", "seeds": 1, "lines": [1]}\n{"file": "y/f.c", "method": "n", "seeds": 2, "lines": [1, 2]}\n')
    assert one(readers.read(spark, "slices", str(tmp_path / "s.json"))).method == "n"


def test_profiles_gate_and_pairs(spark, tmp_path):
    line = "f.c,main,x,def{1,2},use{3},dvars{y, z},pointers{},cfuncs{memcpy{2},puts{1}}"
    df = spark.createDataFrame([(line,), ("Time is 3",), ("",), ("a,b",), (None,)], "value string")
    r = one(readers.parse_profiles(df))
    assert (r["def"], r.use, r.dvars, r.pointers, r.cfuncs) == ([1, 2], [3], ["y", "z"], [], {"memcpy": 2, "puts": 1})
    f = lambda rows: spark.createDataFrame(rows, "commit string, file string, name string, code string")
    pairs = readers.pair_functions(f([("c", "a", "f", "1"), ("c", "a", "g", "2"), ("d", "a", "f", "1")]), f([("c", "a", "f", "9"), ("c", "a", "g", "2"), ("d", "a", "f", "9")]))
    r = one(pairs)
    assert (r.commit, r.name) == ("c", "f")
    s = spark.createDataFrame([("d", "train", "p"), ("d", "validation", "q"), ("e", "odd", "r")], "dataset string, split string, path string")
    assert sorted(tuple(r) for r in readers.best_split(s).collect()) == [("d", "validation", "q"), ("e", "odd", "r")]
    fp = readers.verify_fingerprints(spark.createDataFrame([("a", "1"), ("b", "2"), ("x", "3")], "path string, sha256 string"), spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "4")], "path string, sha256 string"))
    assert {r.path: r.status for r in fp.collect()} == {"a": "ok", "b": "changed", "c": "missing", "x": "extra"}
    log = spark.createDataFrame([("1", "Fix CVE-2020-1234 and cve-2020-1234", ["a.c", "tests/b.c"]), ("2", "Merge CVE-2020-1234", ["a.c"]), ("3", "none", ["a.c"])], "commit string, subject string, paths array<string>")
    r = one(readers.fix_commits(log))
    assert (r.commit, r.cves, r.paths) == ("1", ["CVE-2020-1234"], ["a.c"])
    readers.append_fold(spark.createDataFrame([(1,)], "v int"), str(tmp_path / "folds"), 0)
    readers.append_fold(spark.createDataFrame([(2,)], "v int"), str(tmp_path / "folds"), 1)
    readers.append_fold(spark.createDataFrame([(3,)], "v int"), str(tmp_path / "folds"), 1)
    assert sorted((r.v, r.fold) for r in spark.read.parquet(str(tmp_path / "folds")).collect()) == [(1, 0), (3, 1)]


def test_stream_equals_batch(spark, sf):
    batch = windows.windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).select("start", "event_type", "n").collect()
    assert sorted(batch) == sorted(windows.run_available(spark, f"{sf}/events.parquet").select("start", "event_type", "n").collect())


def test_columns_and_runner(spark, sf, tmp_path):
    from linefold.plans import runner

    (tmp_path / "a.jsonl").write_text('\n{"x": 1, "y": 2}\n')
    (tmp_path / "a.tsv").write_text("p\tq\n1\t2\n")
    assert readers.columns_of(spark, str(tmp_path / "a.jsonl")) == ["x", "y"] and readers.columns_of(spark, str(tmp_path / "a.tsv")) == ["p", "q"]
    assert readers.columns_of(spark, f"{sf}/region.parquet") == ["r_regionkey", "r_name"]
    bad = lambda s, d: s.range(1).select(F.raise_error(F.lit("no")))
    done = runner.run_steps(spark, [("one", lambda s, d: s.range(2)), ("two", bad), ("three", lambda s, d: s.range(1))], sf, str(tmp_path / "out"))
    assert [(d.name, d.error is None) for d in done] == [("one", True), ("two", False)]


def test_trivial_f1_and_insertions(spark):
    r = one(spark.range(1).select(M.always_positive_f1(F.lit(1), F.lit(4)), M.random_guess_f1(F.lit(1), F.lit(4))))
    assert [round(x, 6) for x in r] == [0.4, round(0.25 / 0.75, 6)]
    df = spark.createDataFrame([(0, 2), (3, 1), (1, 0)], "d int, a int")
    assert tuple(one(df.agg(*M.insertion_counts(F.col("d"), F.col("a"))))) == (2, 1)


def test_profile_features(spark):
    from linefold.operators import code
    from linefold.runtime import ship

    ship(spark)
    df = spark.createDataFrame([("int f(char *s) {\n  int n = strlen(s);\n  char *p = s;\n  return n;\n}",)], "c string").withColumn("p", code.variable_profiles(F.col("c")))
    r = one(df.select(code.profile_features(F.col("p")).alias("a"), code.profile_features(F.col("p"), F.array(F.lit("n"))).alias("n"), code.profile_features(F.col("p"), F.array(F.lit("zz"))).alias("z"), code.slice_vector(F.col("c")).alias("v")))
    assert "cf:strlen" in r.a and "var:s" in r.a and r.n == ["var:n"] and r.z == r.a and len(r.v) == 4 and all(x > 0 for x in r.v)


def test_numbered_and_next_holder(spark):
    df = spark.range(0, 500, 1, 7).select((F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("v")).distinct()
    got = [(r.v, r.place) for r in S.numbered(df, "v").orderBy("v").collect()]
    assert [p for _, p in got] == list(range(len(got)))
    holders = spark.createDataFrame([(d, k) for k, ds in (("a", [1, 5, 9, 70, 71, 300]), ("b", [2]), ("c", [9, 64])) for d in ds], "doc_id bigint, key string")
    assert sorted((r.doc_id, r.y) for r in regions.next_holder(holders, 8).collect()) == [(1, 5), (5, 9), (9, 64), (9, 70), (70, 71), (71, 300)]


def test_tables_are_written_and_cleared(spark, tmp_path):
    import os

    from linefold import runtime

    df, path = runtime.materialize_at(spark.range(3), "t")
    assert df.count() == 3 and runtime.own_dir(spark) in path and os.path.isdir(path.removeprefix("file:"))
    runtime.discard(spark, path)
    assert not os.path.isdir(path.removeprefix("file:"))
