"""Language identification, hard negatives and ranked search against direct computations."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from linefold.llm import hard_negatives as N
from linefold.llm import language_id as G
from linefold.llm import ranked_search as R

DOCS = "doc_id bigint, text string, lang string, source string"


# ---- ranked search


def brute_ranked(docs, items, k=10):
    """docs [(id, text)], items [(id, text)] -> sorted rows (item, rank, doc, score)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, Counter(split(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in texts:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    found = R.index(d, shard_terms=kw.pop("shard_terms", 400_000))
    return sorted((tuple(r) for r in R.search(found, q, **kw).collect()), key=repr)


def test_ranked_search_on_odd_texts(spark):
    words = "alpha Beta gamma été ÉTÉ 12 x日本 delta".split()
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ",\t", "_", "\n", "'"]) for _ in range(n))
    docs = [(i, text(int(rng.integers(0, 30)))) for i in range(60)]
    docs += [(100 + i, "alpha beta beta rare") for i in range(25)] + [(100, "alpha beta beta rare"), (None, "rare rare"), (7, None), (8, ""), (9, "-- ''"), (200, text(5000))]
    items = [(1, "ALPHA beta rare"), (2, "rare rare rare 12"), (3, "unknown"), (4, None), (5, ""), (6, "Été"), (6, "ÉTÉ"), (None, "x日本 delta")]
    want = brute_ranked(docs, items)
    assert len(want) == 40
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, shard_terms=50) == want  # many shards
    assert ranked(spark, docs, items, block_bytes=12) == want  # items in several blocks


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None), (2, "")], [(1, "a")]), ([(1, "a")], [(1, "a")])])
def test_ranked_search_on_empty_tables(spark, docs, items):
    assert ranked(spark, docs, items) == brute_ranked(docs, items)


def test_best_keeps_ties_by_id():
    score, ids = np.array([5, 9, 5, 0, 5, 5], np.int64), np.array([40, 1, 10, 0, 30, 20], np.int64)
    assert ids[R.best(score, ids, 3)].tolist() == [1, 10, 20]


# ---- hard negatives


def brute_mined(rows, every=50):
    """rows [(id, vector, label)] with distinct ids."""
    e = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, la, va in e:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, lab) for i, lab, v in e if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            hard = sorted(x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, r, i, -s, -n) for r, (n, i, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows):
    t = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id bigint, embedding array<float>, label int, key string").repartition(3)
    return sorted(tuple(r) for r in N.mine(t).collect())


def test_hard_negatives_with_ties_copies_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 0.3, (12, 8))
    rows = [(i, [float(x) for x in np.round(centers[i % 12] + rng.normal(0, 0.1, 8), 2)], int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(300)]  # copies of one vector, many of them anchors
    rows += [(2000, None, 1), (2050, [0.1] * 8, None), (2100, [0.1, None] + [0.2] * 6, 1), (2150, [float("nan")] * 8, 2), (2200, [float("inf")] * 8, 2), (2250, [], 1), (2300, [0.5, 0.4], 3), (None, [0.3] * 8, 1)]
    want = brute_mined(rows)
    assert len(want) > 150
    assert mined(spark, [*rows, *rows[:40]]) == want  # repeated rows count once
    monkeypatch.setattr(N.Shape, "block_rows", 64)  # many cells and blocks
    assert mined(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(50, [0.1] * 4, 1)], [(50, None, 1), (1, [0.2], 1)], [(0, [], 1), (1, [], 1), (2, [], 0)]])
def test_hard_negatives_on_small_tables(spark, rows):
    assert mined(spark, rows) == brute_mined(rows)


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 3, (200, 16)) for m in (-40, 0, 40)]).round()
    a, c = N.grow(x, np.arange(600), 0, 0, 40), N.grow(x, np.arange(600), 0, 0, 40)

    def leaves(b):
        return [b] if not b.parts else [y for p in b.parts for y in leaves(p)]

    for p in leaves(a):
        for q in leaves(c):
            s = x[p.rows] @ x[q.rows].T
            low, high = N.interval(p, q)
            assert low <= s.min() and s.max() <= high
    # groups far from a node are pruned as a whole: few pairs of leaves are scored
    g = N.Group(0, 0, b"k" * 16 * 200, b"", np.full((200, 1), 20_000), np.full((200, 1), N.FAR))
    search = N.Search(g, x[400:], 6, True)
    assert 0 < len(list(search.pairs(N.grow(x[400:], np.arange(200), 0, 0, 40), [c]))) < len(leaves(c)) * 8


def test_large_components_stay_exact(spark):
    rows = [(50 * i, [float(1 << 18) + i, -3.0 * i], i % 2) for i in range(12)]
    assert mined(spark, rows) == brute_mined(rows)


# ---- languages

WORDS = {"aa": "kala mana tuli vesi puu talo".split(), "bb": "strom glück weiß für nacht und".split(), "cc": "дом река свет ночь".split()}


def corpus(n, seed, langs=tuple(WORDS)):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang := langs[i % len(langs)]], int(rng.integers(3, 200)))), lang) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], DOCS).repartition(3)


def test_windows_hold_each_byte_once():
    for n in (0, 1, 255, 256, 257, 1000):
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        w = G.windows(text)
        assert w.shape == (max(1, -(-n // G.LENGTH)), G.LENGTH + G.AHEAD)
        assert w[:, : G.LENGTH].tobytes()[:n] == text and not any(w[:, : G.LENGTH].tobytes()[n:])
        for k in range(len(w) - 1):
            assert w[k, G.LENGTH :].tobytes() == w[k + 1, : G.AHEAD].tobytes()


def test_tables_equal_the_plain_network():
    rows = corpus(60, 1)
    x = np.concatenate([G.windows(t.encode()) for _, t, _ in rows])
    y = [lang for _, t, lang in rows for _ in G.windows(t.encode())]
    net = G.train(x, y, steps=30)
    plain = G.softmax(G.features(net, x) @ net.dense + net.out)
    assert np.abs(plain - G.probabilities(net, G.tables(net), x)).max() < 1e-4
    # the definition, place by place
    f = net.filters[2]
    want = max(float(net.embed[x[0, p : p + 4]].ravel() @ f[:, 5] + net.bias[2][5]) for p in range(G.LENGTH))
    assert abs(max(0, want) - G.features(net, x[:1])[0, 2 * 24 + 5]) < 1e-4


def test_training_descends_along_the_gradient():
    rows = corpus(90, 2)
    x = np.concatenate([G.windows(t.encode())[:1] for _, t, _ in rows])
    y = [lang for *_, lang in rows]

    def loss(net):
        p = G.softmax(G.features(net, x) @ net.dense + net.out)
        return -np.log(p[np.arange(len(y)), [net.languages.index(v) for v in y]]).mean()

    assert loss(G.train(x, y, steps=60)) < 0.3 * loss(G.train(x, y, steps=1))


def test_languages_on_held_out_and_odd_rows(spark):
    odd = [(5001, None, "aa"), (5002, "", "bb"), (5003, "12 -- 34", "cc"), (5004, "a", None), (None, "река ночь дом", "cc"), (5005, " ".join(["дом"] * 60_000), None), (5005, " ".join(["дом"] * 60_000), None)]
    docs = table(spark, corpus(400, 4) + odd)
    got = G.identify(docs, G.fit(docs)).collect()
    assert len(got) == 407 and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out]
    truth = {i: lang for i, _, lang in corpus(400, 4)}
    assert {r.doc_id for r in held if r.doc_id < 400} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.lang_pred == truth[r.doc_id] for r in held if r.doc_id in truth)
    assert [(by[i].lang_pred, by[i].score) for i in (5001, 5002, 5003)] == [("und", 0.0)] * 3
    assert by[5004].lang_pred in WORDS and by[None].lang_pred == by[5005].lang_pred == "cc" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5005}) == 1


def test_languages_without_labels_or_with_one(spark):
    none = table(spark, [(1, "word", None), (2, None, None)])
    assert {(r.doc_id, r.lang_pred, r.score) for r in G.identify(none, G.fit(none)).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    one = table(spark, [(1, "word", "aa"), (3, "other", None), (4, "5", "aa")])
    assert {(r.doc_id, r.lang_pred) for r in G.identify(one, G.fit(one)).collect()} == {(1, "aa"), (3, "aa"), (4, "und")}
    empty = table(spark, [])
    assert G.identify(empty, G.fit(empty)).collect() == []


def test_held_out_accuracy_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in G.identify(docs, G.fit(docs)).collect() if r.held_out and r.lang_pred != "und"]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
