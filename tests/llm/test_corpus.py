"""The operators that look at the whole corpus, against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linefold.llm import decontaminate as D
from linefold.llm import minhash as M
from linefold.llm import mixing as X
from linefold.llm import quality as Q
from linefold.llm import suffix_dedup as S
from linefold.llm.components import components_of, connected_components
from linefold.llm.wordhash import shingle_sets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s0"), len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


# -- components and near duplicates --------------------------------------------------


def roots_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    nodes = {x for e in edges for x in e}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots_of(nodes, edges)
    assert all(got.get(n, n) == want[n] for n in nodes)


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(7).shuffle(order)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")).collect()}
    assert got == {n: 0 for n in order}


def jobs_of(spark, work):
    """How many jobs the driver had to plan for work()."""
    sc = spark.sparkContext
    group = f"jobs-{uuid.uuid4()}"
    sc.setJobGroup(group, group)
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_stars_take_no_round(spark):
    stars = spark.createDataFrame([(10 * i, 10 * i + j) for i in range(20) for j in range(1, 9)], "a bigint, b bigint")
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "a bigint, b bigint")
    few = jobs_of(spark, lambda: connected_components(stars))
    # a first fold and one look at it; it took 16 while a round showed that nothing changes
    assert 0 < few <= 8, few
    assert jobs_of(spark, lambda: connected_components(path)) > few


def test_components_of_several_graphs(spark):
    rng = random.Random(11)
    high = 2**60
    graphs = [[(high + rng.randrange(150), high + rng.randrange(150)) for _ in range(n)] for n in (90, 40, 0)]
    frames = [spark.createDataFrame(g, "a bigint, b bigint") for g in graphs]
    for g, found in zip(graphs, components_of(frames[:2]) + components_of(frames[2:]), strict=True):
        want = roots_of({x for e in g for x in e}, g)
        got = {r.node: r.root for r in found.collect()}
        assert all(got.get(n, n) == want[n] for n in want) and set(got) == {x for e in g if e[0] != e[1] for x in e}
    one = components_of([frames[0], frames[1]])
    assert [dict(f.dtypes) for f in one] == [{"node": "bigint", "root": "bigint"}] * 2
    # both take the rounds of the longer one
    both, alone = jobs_of(spark, lambda: components_of(frames[:2])), [jobs_of(spark, lambda f=f: connected_components(f)) for f in frames[:2]]
    assert both < sum(alone)


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def set_of(t, k):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(texts, k, percent):
    sets = [(i, set_of(t, k)) for i, t in texts]
    edges = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return {i: len(s) for i, s in sets}, roots_of([i for i, _ in sets], edges)


def near_texts(seed=5):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    out = [None, "", " \n ", "one", "ONE", "a b", "A  b\n"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 20, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            w = list(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            base = w if rng.random() < 0.5 else base  # chains, so that a group's ends are far apart
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("k,seed", [(2, 5), (5, 6)])
def test_near_duplicates_against_brute_force(spark, k, seed):
    texts = near_texts(seed)
    size, root = brute_near(texts, k, 80)
    got = M.near_duplicates(frame(spark, texts), k=k).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id), r


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ITEMS", (30, 200))
    texts = near_texts(8)
    # a template whose copies link to it and seldom to each other, and its hub is a copy
    rng = random.Random(3)
    base = ["t%d" % i for i in range(100)]
    for i in range(40):
        texts.append((len(texts), " ".join(w if j % 20 or rng.random() < 0.2 else f"c{i}" for j, w in enumerate(base))))
    texts.append((len(texts), " ".join(base)))
    size, root = brute_near(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(frame(spark, texts), k=2).collect()} == {i: (size[i], root[i]) for i, _ in texts}


def test_near_duplicates_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    size, root = brute_near(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs, k=2).collect()} == {i: (size[i], root[i]) for i, _ in texts}


def test_near_duplicates_odd_rows(spark):
    assert M.near_duplicates(frame(spark, [])).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, "x y z q r s"), (4, "a b c d e f"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(frame(spark, rows), k=2).collect()), key=str)
    assert got == sorted([(3, 5, 3, True), (3, 5, 3, True), (None, 5, 3, False), (4, 5, 4, True), (4, 5, 3, False), (None, 0, None, True)], key=str)


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        key = M.sketch(a, 532)
        assert (key != np.iinfo(np.uint64).max).all() and (M.sketch(np.sort(a), 532) == key).all()
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    agree = np.mean([(M.sketch(a[: 300], 532) == M.sketch(a[100:], 532)).mean()])
    assert abs(agree - 0.5) < 0.1


def test_shingles_follow_bytes():
    texts = ["A b  c", "a B c", "", "x", "x y", " x ", "é b c"]
    sets = shingle_sets([t.encode() for t in texts], 2)
    assert [len(s) for s in sets] == [2, 2, 0, 1, 1, 1, 2]
    assert (sets[0] == sets[1]).all() and (sets[3] == sets[5]).all() and sets[3][0] != sets[4][0]


# -- suffix sorting ----------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 200), max_size=80))
def test_suffix_array(s):
    assert S.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=5, max_size=20).map(str.encode), min_size=1, max_size=6))
def test_equal_windows(contexts):
    owner, off, group = S.equal_windows(contexts, 5)
    strings = [contexts[o][p : p + 5] for o, p in zip(owner, off, strict=True)]
    assert len(strings) == sum(len(c) - 4 for c in contexts)
    by = {}
    for s, g in zip(strings, group.tolist(), strict=True):
        by.setdefault(g, set()).add(s)
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(strings))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200) | st.text(alphabet="ab", max_size=200).map(str.encode))
def test_anchors_cover_every_window_once(data):
    h, _, first, last, at = S.anchors(data, 30, 10)
    covered = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
    assert covered == list(range(max(0, len(data) - 29)))
    assert all(a <= x and x + 10 <= a + 30 and b <= x for a, b, x in zip(first, last, at, strict=True) for a, b in ((a, b),))


def brute_removed(texts, length):
    order = sorted(texts, key=lambda x: x[0])
    seen, out = set(), {}
    for i, t in order:
        data = (t or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        out[i] = (len(data), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def repeat_texts(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "stone", "river", "zzz", "aa", "Ω"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(40), line(26), "x" * 300, line(60)]
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 250]
    for _ in range(40):
        parts = [line(rng.randrange(30)) for _ in range(3)]
        s = rng.choice(shared)
        a = rng.randrange(len(s) // 2)
        parts.insert(rng.randrange(3), s[a : a + rng.randrange(20, 400)])
        out.append(rng.choice([" ", "\n", ""]).join(parts))
    out += [out[10], out[11] + "tail", shared[0] * 3]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [50_000, 3])
def test_suffix_dedup_against_brute_force(spark, block):
    texts = repeat_texts(block)
    want = brute_removed(texts, 100)
    got = {r.doc_id: tuple(r)[1:] for r in S.report(frame(spark, texts), block=block).collect()}
    assert got == want


def test_suffix_dedup_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_removed([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert {r.doc_id: tuple(r)[1:] for r in S.report(docs).collect()} == want


def test_suffix_dedup_odd_rows(spark):
    assert S.report(frame(spark, [])).count() == 0
    t = "abc " * 40
    u = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(5, u), (5, u), (None, u + "q"), (6, u), (7, "z" + u), (6, "other")]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in S.report(frame(spark, rows)).collect())
    n = len(u)
    assert got == sorted([("5", n, n), ("5", n, n), ("None", n + 1, 0), ("6", n, n), ("7", n + 1, n), ("6", 5, 0)])
    assert S.keep_text("aé" .encode(), np.array([True, False, True])) == "é"
    assert S.report(frame(spark, [(1, t)])).collect()[0].n_removed == len(t) - 4


@pytest.mark.parametrize("block", [1, 50_000])
def test_suffix_dedup_with_hot_keys(spark, monkeypatch, block):
    monkeypatch.setattr(S, "HOT_ROWS", 3)
    rng = random.Random(11)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40))) + shared[rng.randrange(60) :] + str(i) * rng.randrange(9)) for i in range(40)]
    want = brute_removed(texts, 100)
    assert {r.doc_id: tuple(r)[1:] for r in S.report(frame(spark, texts), block=block).collect()} == want


# -- decontamination -------------------------------------------------------------------------


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


ITEM = "A farmer named Anna sells 12 baskets of apples for 3 dollars and gives Anna twice as many pears before noon"


def test_decontamination_cases(spark):
    docs = frame(
        spark,
        [
            (1, "intro words here. " + ITEM + " and more"),
            (2, ITEM.replace("Anna", "Boris").replace("12", "40").replace("dollars", "euros")),
            (3, ITEM.replace("Anna", "Boris", 1)),  # one slot stands for two names
            (4, "the of and to in is it " * 30),
            (5, None),
            (6, ""),
            (7, ITEM.upper()),
            (8, "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lena " * 3),
            (9, ITEM),
            (9, "nothing of the kind"),
        ],
    )
    items = bench(spark, [ITEM, None, "", "12 3 45 km 7 8 9 10 11 12 13", "tiny item"])
    got = {(r.doc_id, r.item_id): r for r in D.find(docs, items).collect()}
    assert set(got) == {(1, 0), (2, 0), (9, 0)}
    assert got[1, 0].verbatim and not got[2, 0].verbatim and got[1, 0].start_word == 3 and got[1, 0].share == 1
    kept = sorted((r.doc_id or 0) for r in D.clean(docs, items).collect())
    assert kept == [3, 4, 5, 6, 7, 8]
    assert D.find(frame(spark, []), items).count() == 0 and D.find(docs, bench(spark, [])).count() == 0


def test_decontamination_of_the_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    d, b = docs.collect(), items.collect()
    flat = lambda t: " ".join(re.findall(r"\w+", t))
    verbatim = {(x.doc_id, y.item_id) for x in d for y in b if flat(y.text) in flat(x.text)}
    got = {(r.doc_id, r.item_id) for r in D.find(docs, items).collect()}
    assert verbatim <= got and len({x for x, _ in got}) <= len({x for x, _ in verbatim}) + 0.01 * len(d)


# -- mixing ------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: 3 * sizes[s] for s in capped} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t
        capped |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 3}, {"a": 100}, {"z": 0, "b": 7, None: 900, "c": 1, "d": 1, "é": 40}])
def test_mixing_against_brute_force(spark, sizes):
    texts, sources, i = [], {}, 0
    for s, n in sizes.items():
        left = n
        while left > 0:
            k = min(left, 1 + (i * 7) % 13)
            texts.append((i, " ".join(["w"] * k)))
            sources[i] = s
            left, i = left - k, i + 1
    texts.append((i, None))
    sources[i] = next(iter(sizes))
    rows = [(d, t, "en", sources[d], 0) for d, t in texts]
    mixed = X.mix(spark.createDataFrame(rows, DOCS)).persist()
    got = mixed.collect()
    want = brute_targets({s: n for s, n in sizes.items() if n or any(x == s for x in sources.values())})
    assert len(got) == len(texts)
    taken = {}
    for r in got:
        s = sources[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in taken)
    queue = X.schedule(mixed).collect()
    assert sum(r["take"] for r in queue) == sum(taken.values()) and [r.finish for r in queue] == sorted(r.finish for r in queue)
    assert X.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_cuts_the_sorted_queue(spark):
    rng = random.Random(9)
    docs = frame(spark, [(i, "w " * rng.randrange(12)) for i in range(300)], {i: f"s{i % 7 // 3}" for i in range(300)})
    placed, sources = X.shuffled(docs)
    budget = sources.agg(F.sum("budget")).collect()[0][0]
    q = X.queue(placed)
    rows = sorted(q.collect(), key=lambda r: r.place)
    assert [r.finish for r in rows] == sorted(r.finish for r in rows) and any(r.finish > 1 for r in rows)
    for some in (0, 1, 17, budget, 10**9):
        left, want = some, {}
        for r in rows:
            want[r.place] = min(r.words, left)
            left -= want[r.place]
        for bits in (2, 12):
            assert {r.place: r["take"] for r in X.cut(q, some, bits).collect()} == want
    mixed = X.mix(docs)
    assert {(r.doc_id, r.copy): r["take"] for r in X.cut(q, budget).groupBy("doc_id", "copy").agg(F.sum("take").alias("take")).where("take > 0").collect()} == {
        (r.doc_id, k): t for r in mixed.collect() for k, t in enumerate(r.takes) if t
    }


# -- quality ------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    s = Q.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good = [r.score for r in s if r.quality == 1]
    bad = [r.score for r in s if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean([r.predicted == r.quality for r in s]) > 0.9


def test_quality_rules_and_column(spark):
    rng = np.random.default_rng(2)
    x = rng.random((600, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    m = Q.fit_rules(x, y, ["p", "q"])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "p double, q double, y double")
    acc = df.withColumn("s", m.column({"p": F.col("p"), "q": F.col("q")})).agg(F.avg(((F.col("s") > 0.5) == (F.col("y") > 0.5)).cast("int"))).collect()[0][0]
    assert acc > 0.97 and 0 < len(m.rules) < 60


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [(1, None), (None, ""), (3, "x" * 100_000)])
    assert {r.score for r in Q.score(docs, labels).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = Q.score(docs, one).collect()
    assert len(got) == 3 and all(0 < r.score < 1 for r in got) and Q.score(frame(spark, []), one).count() == 0


def test_near_duplicates_large_loose_group(spark):
    # many edited copies of one text: a large component, stragglers, and links between stragglers only
    rng = random.Random(11)
    vocab = ["v%d" % i for i in range(400)]
    base = [rng.choice(vocab) for _ in range(80)]
    texts = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 2, 4, 9, 16])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append((2 * i, " ".join(w)))
        if i % 9 == 0:
            w[rng.randrange(len(w))] = "z"
            texts.append((2 * i + 1, " ".join(w)))
    size, root = brute_near(texts, 2, 80)
    assert len(set(root.values())) > 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(frame(spark, texts), k=2).collect()}
    assert got == {i: (size[i], root[i]) for i, _ in texts}


def test_decontamination_of_rows_without_id(spark):
    docs = frame(spark, [(None, "so " + ITEM), (None, None), (None, "quite another text of many plain words that no item has"), (1, ITEM), (2, "")])
    kept = sorted((r.doc_id or 0, r.text or "") for r in D.clean(docs, bench(spark, [ITEM, "tiny item", "Who wrote Hamlet?"]), strict=False).collect())
    assert kept == [(0, ""), (0, "quite another text of many plain words that no item has"), (2, "")]


def test_decontamination_of_short_items(spark):
    items = ["12 + 30 * 4 = ?", "Who wrote Hamlet?", "Anna Paid Bob 12 Euro And Carl 30 Euro In Rome", "one two three four five", "x"]
    docs = [(i, f"Before it, {t} and after.") for i, t in enumerate(items)] + [(9, "nothing that any item says")]
    got = {(r.doc_id, r.item_id) for r in D.find(frame(spark, docs), bench(spark, items), strict=False).collect()}
    assert got == {(i, i) for i in range(5)}


def test_window_hashes_stand_for_windows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(3) for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))]) for i in range(20)]
    widths = [1, 2, 3, 5, 7, 8]
    df = D._rolled(spark.createDataFrame(rows, "i bigint, c array<bigint>"), "c", widths)
    seen = {}
    for r in df.collect():
        for w in widths:
            h = r["c"] if w == 1 else r[f"c_{w}"]
            wins = [tuple(r["c"][k : k + w]) for k in range(len(r["c"]) - w + 1)]
            assert len(h) == len(wins)
            for a, b in zip(h, wins):
                assert seen.setdefault((w, b), a) == a
    for w in widths:
        own = [a for (x, _), a in seen.items() if x == w]
        assert len(own) == len(set(own))


def test_decontamination_of_longer_names(spark):
    named = ITEM.replace("Anna", "Anna Maria").replace("12", "40")  # the words behind a name move
    r = D.find(frame(spark, [(2, "intro. " + named)]), bench(spark, [ITEM]), strict=False).collect()
    assert [(x.doc_id, x.share, x.start_word, x.verbatim) for x in r] == [(2, 1.0, 1, False)]


def test_only_texts_with_matches_are_split_twice(spark, monkeypatch):
    """The texts whose matches are looked at lie apart: else a condition on their words would split every text again."""
    written = {}
    monkeypatch.setattr(D, "materialize", lambda df, name, own=D.materialize: written.setdefault(name, own(df, name)))
    docs = frame(spark, [(1, "intro. " + ITEM), *((k, f"plain words of text number {k} and nothing else in it") for k in range(2, 30))])
    assert [x.doc_id for x in D.find(docs, bench(spark, [ITEM]), strict=False).collect()] == [1]
    assert [x.doc_id for x in written["decon-texts"].collect()] == [1]


def test_runs_are_found_by_hashes_as_by_templates(spark):
    docs = frame(spark, [(1, "Anna Maria Lee sold 3 4 kg to Bob 7 Cat and 5 km or NASA Eve Eve"), (2, "one"), (3, "Tom Tim"), (4, "... !"), (5, None)])
    want = {r.doc_id: r for r in D._tokens(docs, "doc_id").select("doc_id", "starts", D._hashed(F.col("tmpl")).alias("codes"), D._hashed(F.col("tok")).alias("short"), D._hashed(F.col("low")).alias("plain")).collect()}
    assert {r.doc_id: r for r in D._coded(docs).collect()} == want and len(want) == 3


def test_windows_are_hashed_where_spark_compiles(spark):
    """The windows of all widths and kinds; those of eight words, the query's, without a function over arrays."""
    rng = random.Random(9)
    rows = []
    for i in range(30):
        n = rng.choice([1, 2, 3, 7, 8, 9, 15, 40])
        codes = [rng.randrange(4) for _ in range(n)]
        starts = [k for k in range(n) if not (k and codes[k] == codes[k - 1] and codes[k] < 2)]
        rows.append((i, starts, codes, [codes[k] for k in starts], [rng.randrange(4) for _ in range(n)]))
    coded = spark.createDataFrame(rows, "doc_id bigint, starts array<int>, codes array<bigint>, short array<bigint>, plain array<bigint>")
    every = {"template", "words", "runs"}
    for shapes in ({8: every}, {8: {"template"}, 2: {"words"}}, {1: every, 3: {"words"}, 5: every, 8: every}, {12: every, 7: {"words"}, 1: {"words"}}, {20: every, 2: every}):
        held = coded
        for c in ("codes", "short", "plain"):
            held = D._rolled(held, c, sorted(shapes))
        want = collections.Counter()
        for r in held.collect():
            of = lambda c, w, r=r: enumerate(r[c if w == 1 else f"{c}_{w}"])
            for w, kinds in shapes.items():
                for kind, c in (("template", "codes"), ("words", "plain")):
                    want.update((r.doc_id, k, h) for k, h in of(c, w) if kind in kinds)
                if "runs" in kinds:
                    s = r["starts"]
                    want.update((r.doc_id, s[k], h) for k, h in of("short", w) if s[k + w - 1] > s[k] + w - 1)
        df = D._windows(coded, shapes)
        assert collections.Counter(map(tuple, df.collect())) == want
        assert shapes != {8: every} or "lambda" not in df._jdf.queryExecution().toString()


def test_decontamination_sums_a_band(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    text = " ".join(x for i in range(0, 60, 11) for x in [*words[i : i + 11], "extra"])  # four windows on each diagonal
    r = D.find(frame(spark, [(1, text)]), bench(spark, [" ".join(words)])).collect()
    assert [(x.doc_id, x.n_windows, x.start_word, x.verbatim) for x in r] == [(1, 20, 0, True)]


def test_decontamination_of_items_without_evidence(spark):
    texts = ["What is 17 times 24?", "12 3 45 km 7 8 9 10 11 12 13", "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida Jan"]
    docs = [(i, f"some words {x} and more") for i, x in enumerate(texts)]
    docs += [(3, "What is 18 times 24?"), (4, "12 3 45 km 7 8 9 10 11 12 14"), (5, "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida and Jan")]
    got = D.find(frame(spark, docs), bench(spark, texts)).collect()
    assert sorted((r.doc_id, r.item_id, r.share, r.start_word, r.verbatim) for r in got) == [(i, i, 1.0, 2, True) for i in range(3)]


def test_decontamination_in_any_case(spark):
    docs = frame(spark, [(1, "so " + ITEM.upper()), (2, ITEM.lower()), (3, ITEM.title()), (4, "THE OF AND TO IN IS IT " * 30)])
    got = D.find(docs, bench(spark, [ITEM]), strict=False).collect()
    assert sorted((r.doc_id, r.share, r.start_word, r.verbatim) for r in got) == [(1, 1.0, 1, True), (2, 1.0, 0, True), (3, 1.0, 0, True)]
    assert [r.doc_id for r in D.clean(docs, bench(spark, [ITEM]), strict=False).collect()] == [4]


def test_decontamination_with_a_changed_slot(spark):
    sums = "Alice adds 2 apples to 2 apples that are ripe and puts them into the large green basket near the old door of her house"
    mixed = ITEM.replace("sells 12 baskets", "sells 40 baskets").replace("Anna", "Boris", 1)
    docs = frame(spark, [(3, ITEM.replace("Anna", "Boris", 1)), (4, sums.replace("2", "3", 1).replace("2", "5")), (5, mixed), (6, "He said that the farmer sells many baskets of apples " * 3)])
    got = {(r.doc_id, r.item_id): r for r in D.find(docs, bench(spark, [ITEM, sums]), strict=False).collect()}
    assert set(got) == {(3, 0), (4, 1), (5, 0)}
    assert got[3, 0].n_windows == 14 and not got[3, 0].verbatim  # Anna stands for Boris in all windows that are not equal words


@pytest.mark.parametrize("name", ["op4_mixing", "op5_warc", "op8_suffix_dedup", "op10_minhash"])
def test_queries_against_sql(spark, sf, name):
    import duckdb

    from linefold.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    flat = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    want = sorted(tuple(flat(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall())
    assert sorted(tuple(flat(x[c]) for c in sorted(names)) for x in df.collect()) == want


# -- decontamination in the query's own mode, against a plain computation ------------------------------


def plain_find(docs, items, n, min_windows=5, min_share=0.25, min_literal=3):
    """docs, items [(id, text)] -> {(doc, item): (n_windows, share, start_word, verbatim)}, window by window."""
    import regex

    def template(w):
        low = w.lower()
        if w[0].isascii() and w[0].isdigit():
            return "#num"
        if low == w:
            return "#unit" if w in D.UNITS else w
        return "#name" if w[1:] == low[1:] and len(w) > 1 else low

    def read(text):
        words = regex.findall(r"[\p{L}\p{N}]+(?:[.,'’-][\p{L}\p{N}]+)*", text or "")
        low, tmpl = [w.lower() for w in words], [template(w) for w in words]
        starts = [k for k in range(len(words)) if not (k and tmpl[k] in ("#name", "#num") and tmpl[k] == tmpl[k - 1])]
        said = [" ".join(low[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=False)]
        return {"low": low, "tmpl": tmpl, "starts": starts, "tok": [tmpl[k] for k in starts], "said": said}

    def runs(t, w):
        if len(t["tok"]) >= len(t["low"]):
            return
        for k in range(len(t["tok"]) - w + 1):
            if t["starts"][k + w - 1] > t["starts"][k] + w - 1:
                yield t["starts"][k], tuple(t["tok"][k : k + w])

    out = {}
    for item, text in items:
        i = read(text)
        if not i["low"]:
            continue
        w = min(n, len(i["low"]))
        cut = lambda t, c, p, w=w: tuple(t[c][p : p + w])
        every = range(len(i["low"]) - w + 1)
        evidence = [p for p in every if sum(not x.startswith("#") for x in cut(i, "tmpl", p)) >= min(min_literal, w)]
        whole = not evidence
        places = set(every if whole else evidence)
        bench = {(p, cut(i, "low", p)) for p in places}
        if not whole:
            bench |= {(p, cut(i, "tmpl", p)) for p in places} | {(p, x) for p, x in runs(i, w) if p in places}
        total = len(places)
        for doc, content in docs:
            d = read(content)
            mine = {(p, cut(d, c, p)) for p in range(len(d["low"]) - w + 1) for c in ("low", "tmpl")} | set(runs(d, w))
            spots = {(a, b) for a, x in bench for b, y in mine if x == y}
            groups = {}
            for a, b in spots:
                band = math.floor((b - a) / max(n, total / 4))
                for g in [(0, b - a)] if whole else [(0, b - a), (1, band), (1, band - 1)]:
                    groups.setdefault(g, set()).add((a, b))
            enough = lambda at, total=total, whole=whole: len({a for a, *_ in at}) >= min(min_windows, total) and len({a for a, *_ in at}) >= (1.0 if whole else min_share) * total
            for at in groups.values():
                if not enough(at):
                    continue
                kept = []
                for a, b in at:
                    lit, word = cut(i, "low", a) == cut(d, "low", b), cut(i, "tmpl", a) == cut(d, "tmpl", b)
                    run = False
                    if a in i["starts"] and b in d["starts"]:
                        x, y = i["starts"].index(a), d["starts"].index(b)
                        run = x + w <= len(i["tok"]) and i["tok"][x : x + w] == d["tok"][y : y + w]
                    if not (lit if whole else lit or word or run):
                        continue
                    pairs = []
                    if not whole and not lit:
                        if word:
                            pairs = [(i["low"][a + j], d["low"][b + j]) for j in range(w) if i["tmpl"][a + j].startswith("#")]
                        else:
                            pairs = [(i["said"][x + j], d["said"][y + j]) for j in range(w) if i["tok"][x + j].startswith("#")]
                    kept.append((a, b, pairs))
                count = collections.Counter(p for *_, ps in kept for p in ps)
                stands = {}
                for (v, u), k in count.items():
                    stands[v] = max(stands.get(v, (0, "")), (k, u))
                kept = [x for x in kept if all(stands[v][1] == u for v, u in x[2])]
                if not enough(kept):
                    continue
                hit, first = len({a for a, *_ in kept}), min((a, b) for a, b, _ in kept)[1]
                row = (hit, -first, hit / total, all(v == u for *_, ps in kept for v, u in ps))
                out[doc, item] = max(out.get((doc, item), row), row)
    return {k: (h, s, -f, v) for k, (h, f, s, v) in out.items()}


def test_decontamination_against_a_plain_computation(spark):
    rng = random.Random(12)
    plain = "the of river runs over quiet stone while people carry water into some large house before winter".split()
    slots = ["Anna", "Boris", "Carla", "12", "7.5", "300", "km", "hours", "Paris", "Rome"]
    sentence = lambda n: [rng.choice(plain) if rng.random() < 0.7 else rng.choice(slots) for _ in range(n)]
    items = [(k, sentence(rng.choice([3, 6, 12, 25, 40]))) for k in range(14)]
    items += [(50, ["Anna", "12", "Boris", "7.5", "km", "Paris"]), (51, [])]
    docs = []
    for k in range(90):
        words = list(rng.choice(items)[1])
        how = k % 6
        if how == 1:  # another value for each slot, always the same
            swap = dict(zip(slots, rng.sample(slots[:3], 3) + rng.sample(slots[3:6], 3) + slots[6:8] + rng.sample(slots[8:], 2), strict=True))
            words = [swap.get(w, w) for w in words]
        elif how == 2:  # a new value at every place
            words = [rng.choice([s for s in slots if s[0].isdigit() == w[0].isdigit() and s not in ("km", "hours")]) if w in slots and w not in ("km", "hours") else w for w in words]
        elif how == 3:  # words put in and left out
            words = [x for w in words for x in ([w, rng.choice(plain)] if rng.random() < 0.1 else [] if rng.random() < 0.05 else [w])]
        elif how == 4:  # a name becomes two
            words = [x for w in words for x in (["Anna", "Maria"] if w == "Anna" else [w.upper() if rng.random() < 0.1 else w])]
        elif how == 5:
            words = sentence(30)
        docs.append((k, " ".join(sentence(rng.randint(0, 12)) + words + sentence(rng.randint(0, 12)))))
    docs += [(200, ""), (201, None)]
    items = [(k, " ".join(w)) for k, w in items]
    want = plain_find(docs, items, 5)
    got = D.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), n=5, strict=False).collect()
    assert len(want) > 30
    assert {(r.doc_id, r.item_id): (r.n_windows, pytest.approx(r.share), r.start_word, r.verbatim) for r in got} == want


def test_slots_decide_in_the_query_mode(spark):
    """A copy with one new value for each name and number is found; one with a new value at every place is not."""
    rng = random.Random(3)
    words = "river stone water house winter people carry quiet large over into while runs before after under".split()
    names = ["Anna", "Boris", "Carla", "David"]
    item = [x for k in range(24) for x in (rng.choice(words), rng.choice(names))]
    same = [{"Anna": "Xenia", "Boris": "Yann", "Carla": "Zoe", "David": "Wim"}.get(w, w) for w in item]
    new = [rng.choice(["Xenia", "Yann", "Zoe", "Wim", "Vera", "Uwe", "Tom", "Sven"]) if w in names else w for w in item]
    docs = [(1, "so it is that " + " ".join(same)), (2, "so it is that " + " ".join(new)), (3, " ".join(item))]
    got = {r.doc_id: r for r in D.find(frame(spark, docs), bench(spark, [" ".join(item)]), strict=False).collect()}
    assert set(got) == {1, 3} and got[1].share == 1.0 and not got[1].verbatim and got[3].verbatim


# -- quality: the fit against the conditions of its optimum, the column against the rules ---------------


def test_rules_are_a_lasso_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (rng.random(600) < 0.1)).astype(float)
    names = ["a", "b", "c", "d"]
    penalty = 2e-3
    m = Q.fit_rules(x, y, names, penalty=penalty, steps=6000)
    assert m.rules
    holds = lambda r: np.all([x[:, names.index(c)] <= cut if low else x[:, names.index(c)] > cut for c, low, cut in r.terms], axis=0)
    f = np.stack([holds(r) for r in m.rules], axis=1).astype(float)
    z = m.intercept + f @ np.array([r.weight for r in m.rules])
    p = 1 / (1 + np.exp(-z))
    assert abs((p - y).mean()) < 1e-3  # the free intercept
    s = (f - f.mean(axis=0)) / f.std(axis=0)
    slope = s.T @ (p - y) / len(y)
    w = np.array([r.weight for r in m.rules]) * f.std(axis=0)
    big = np.abs(w) > 0.02
    assert big.any() and np.abs(slope[big] + penalty * np.sign(w[big])).max() < 5e-4  # rules that count are at the bound
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(m.column({c: F.col(c) for c in names})).collect()]
    assert np.allclose(got, p)
