"""Archives, documents, downloads, XML features, encoders, train-fit models and command lines."""

import decimal
import gzip
import http.server
import io
import json
import tarfile
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from linefold import cli
from linefold.functions import csource
from linefold.functions.markup import xml_features
from linefold.operators import code, embeddings, logistic, match, model, representations
from linefold.operators import statistics as S
from linefold.sources import archives, documents


def test_archives(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    with zipfile.ZipFile(folder / "x.zip", "w") as z:
        z.writestr("d/one.csv", "a,b\n1,2\n")
        z.writestr("../two.csv", "no")
        z.writestr("big.csv", "x" * 500)
        z.writestr("three.txt", "no")
    with tarfile.open(folder / "y.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("k/four.csv")
        info.size = 3
        t.addfile(info, io.BytesIO(b"c\n1"))
    (folder / "five.csv.gz").write_bytes(gzip.compress(b"q"))
    (folder / "bad.zip").write_bytes(b"junk")
    (folder / "cut.gz").write_bytes(gzip.compress(b"abc")[:-6])
    got = archives.read_archives(spark, str(folder), ("*.csv", "cut"), 100).collect()
    seen = {(r.archive.rsplit("/", 1)[-1], r.member): (bytes(r.content) if r.content is not None else None, bool(r.error)) for r in got}
    assert seen[("x.zip", "d/one.csv")] == (b"a,b\n1,2\n", False) and seen[("y.tar.gz", "k/four.csv")] == (b"c\n1", False) and seen[("five.csv.gz", "five.csv")] == (b"q", False)
    assert seen[("x.zip", "../two.csv")] == (None, True) and seen[("x.zip", "big.csv")] == (None, True) and seen[("bad.zip", None)] == (None, True) and seen[("cut.gz", None)] == (None, True)
    assert len(seen) == 7


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "t.arff").write_text("% c\n@relation r\n@attribute 'a b' numeric\n@attribute c {x,y}\n@data\n1.5,x\n?,'y'\n")
    (tmp_path / "t.bin").write_text("no")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in archives.table_files(spark, str(tmp_path)).collect()) == ["t.arff", "t.csv", "t.jsonl"]
    assert [tuple(r) for r in archives.read_table(spark, str(tmp_path / "t.arff")).collect()] == [(1.5, "x"), (None, "y")]
    assert archives.read_table(spark, str(tmp_path / "t.arff")).columns == ["a b", "c"] and archives.read_table(spark, str(tmp_path / "t.jsonl")).count() == 2
    with pytest.raises(ValueError):
        archives.read_table(spark, "t.bin")
    assert archives.address("zenodo", "7", file="a.zip").endswith("7/files/a.zip?download=1")
    with pytest.raises(ValueError):
        archives.address("nowhere", "1")


class Ranged(http.server.BaseHTTPRequestHandler):
    DATA = bytes(range(256)) * 40
    asked: list = []
    broken = 1

    def do_GET(self):
        at = self.headers.get("Range")
        type(self).asked.append(at)
        start = int(at.split("=")[1].rstrip("-")) if at else 0
        if start >= len(self.DATA):
            self.send_response(416)
            self.end_headers()
            return
        body = self.DATA[start:]
        self.send_response(206 if at else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if type(self).broken:  # the first answer stops half way
            type(self).broken -= 1
            body = body[: len(body) // 2]
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_download_goes_on(tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranged)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    try:
        assert archives.download(url, str(tmp_path / "f"), wait=0.01) == len(Ranged.DATA) and (tmp_path / "f").read_bytes() == Ranged.DATA
        assert Ranged.asked == [None, f"bytes={len(Ranged.DATA) // 2}-"]
        (tmp_path / "g.part").write_bytes(Ranged.DATA)
        assert archives.download(url, str(tmp_path / "g"), wait=0.01) == len(Ranged.DATA)
    finally:
        server.shutdown()


def test_documents_and_console(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", float("nan")), ("b", "x", 2.5)], "g string, k string, v double")
    doc = documents.write_document(str(tmp_path / "d.json"), {"nested": documents.section(df, ("g", "k")), "rows": documents.section(df.where("g = 'b'")), "odd": {"s": {3, 1}, "n": np.float64(2), "d": decimal.Decimal("1.5"), "b": b"\x01"}})
    assert json.load(open(tmp_path / "d.json")) == doc
    assert doc == {"nested": {"a": {"x": 1.0, "y": None}, "b": {"x": 2.5}}, "rows": {"g": "b", "k": "x", "v": 2.5}, "odd": {"s": [1, 3], "n": 2.0, "d": 1.5, "b": "01"}}
    text = documents.console_table(df.orderBy("g", "k"), digits=2, most=2)
    assert text.splitlines() == ["g  k     v", "-  -  ----", "a  x  1.00", "a  y   nan", "..."]


def test_xml_features():
    xml = (
        '<unit xmlns:pos="urn:p"><decl_stmt pos:start="2:1"><type pos:start="2:1"><name>char</name><modifier>*</modifier></type><name>p<index pos:start="2:7"/></name></decl_stmt>'
        '<if pos:start="3:1"><call pos:start="3:5"><name><name>a</name><operator pos:start="3:6">-&gt;</operator><name>run</name></name><argument_list><literal type="string" pos:start="3:9">"x"</literal></argument_list></call></if></unit>'
    )
    assert xml_features(xml) == [(2, "decl"), (2, "type:char"), (2, "mod:*"), (2, "idx"), (3, "ctrl:if"), (3, "call"), (3, "callee:run"), (3, "op:->"), (3, "lit:string")]
    assert xml_features("<a>") == xml_features("") == [] and xml_features("<x><operator>+</operator></x>") == [(-1, "op:+")]


WORKED = """static void show(struct out *o, const char *dat, int length)
{
  int left = length;
  log_all(o);
  PRINT(o, dat[0]);
  if (left > 4) {
    PRINT(o);
    put(o, dat + 4, left - 4);
  }
}
"""


def test_worked_example():
    m = csource.measures(WORKED)
    assert [x + 1 for x in m["sinks"]] == [4, 5, 7, 8] and [x + 1 for x in m["kept"]] == [3, 4, 5, 6, 7, 8] and m["n_lines"] == 10 and m["status"] == "matched"
    assert [x + 1 for x in m["data"]] == [3, 4, 5, 7, 8] and m["depth"] == 2 - 1
    kept, sinks, status = csource.slice_lines(WORKED)
    assert (kept, sinks, status) == (m["kept"], m["sinks"], m["status"])
    walk = csource.trace(WORKED)
    assert walk[0]["line"] == 7 and {w["line"] for w in walk} == {2, 3, 4, 5, 6, 7}


def test_measures_equal_slices():
    for text in ("", "junk", "int f(int a)\n{\n  return a;\n}\n", WORKED, WORKED.replace("put", "memcpy")):
        m = csource.measures(text)
        for key, args in (("kept", ()), ("data", ("all", ("data",))), ("memory", ("memory",))):
            assert m[key] == csource.slice_lines(text, *args)[0], (key, text)
        assert (m["sinks"], m["status"]) == csource.slice_lines(text)[1:]


def test_versions_delta(spark):
    df = spark.createDataFrame([(WORKED, WORKED.replace("left - 4", "left * 4")), (WORKED, WORKED)], "before string, after string")
    got = [(r.phi_removed, r.phi_added) for r in code.versions_delta(df).collect()]
    assert got == [(["op:-"], ["op:*"]), ([], [])]


def test_encoder_sees_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "A  B"), (5, " ".join(["w"] * 600) + " zzz")], "doc_id bigint, text string")
    got = {r.id: r.embedding for r in embeddings.embed(docs, embeddings.hashed_encoder).collect()}
    assert got[1] == got[2] and got[3] == [0.0] * 4 and got[4] == pytest.approx(got[1])
    one = embeddings.masked_mean(*embeddings.hashed_encoder()(["w"]))[0]
    assert got[5] == pytest.approx(list(one))


def test_train_fit_against_direct_computation(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(25)] + (["good"] * 9 if k % 3 == 0 else ["bad"] * 5), 30)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folds = spark.createDataFrame([(k, 0, (k // 3) % 5, int(k % 3 == 0)) for k in range(60)], "doc bigint, repeat bigint, fold bigint, label int")
    terms = representations.terms(docs, "WHOLE_TEXT")
    rows = model.train_fit_tfidf(terms, folds, size=40)
    grams = [t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])] for t in texts]
    want = {}
    for f in range(5):
        train = [k for k in range(60) if (k // 3) % 5 != f]
        total, df = {}, {}
        for k in train:
            for g in grams[k]:
                total[g] = total.get(g, 0) + 1
            for g in set(grams[k]):
                df[g] = df.get(g, 0) + 1
        vocab = sorted(total, key=lambda g: (-total[g], g))[:40]
        x = np.array([[grams[k].count(g) * (np.log((1 + len(train)) / (1 + df[g])) + 1) for g in vocab] for k in range(60)])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        want[f] = x
    for r in rows.collect():
        x = np.zeros(40)
        x[r["at"]] = r.weights
        assert np.allclose(x, want[r.fold][r.doc]) and r.test == ((r.doc // 3) % 5 == r.fold)
    # the scores, by gradient descent on the same objective
    y = np.array([k % 3 == 0 for k in range(60)], float)
    scores = {(r.fold, r.row_id): r.score for r in logistic.sparse_scores(rows.withColumn("rep", F.lit("x"))).collect()}
    assert len(scores) == 60
    f = 0
    test = np.array([(k // 3) % 5 == f for k in range(60)])
    xt, yt = want[f][~test], y[~test]
    w = np.where(yt == 1, len(yt) / (2 * yt.sum()), len(yt) / (2 * (len(yt) - yt.sum())))
    beta, b = np.zeros(40), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(xt @ beta + b)))
        beta -= 0.1 * (xt.T @ (w * (p - yt)) + beta)
        b -= 0.1 * (w * (p - yt)).sum()
    p = 1 / (1 + np.exp(-(want[f][test] @ beta + b)))
    assert np.allclose([scores[f, k] for k in np.flatnonzero(test)], p, atol=1e-4)


def test_every_representation_has_terms(spark):
    docs = spark.createDataFrame([(1, "one 2 three\nfour five\nsix, 7"), (2, ""), (3, "plain words only")], "doc_id bigint, text string")
    for name in representations.REGISTRY:
        t = {(r.doc, r.tok): r.tf for r in representations.terms(docs, name).collect()}
        assert any(d == 1 for d, _ in t) and all(v > 0 for v in t.values()), name
        if name.startswith("AUG"):
            assert (2, "EMPTYFEAT") in t
    with pytest.raises(ValueError):
        representations.terms(docs, "nope")


def test_running_and_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 3}", float(v)) for i, v in enumerate(rng.integers(0, 20, 200))] + [("g9", 1.0), ("g9", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.q for r in S.grouped_quantiles(df, ["g"], "v", [0, 0.1, 0.25, 0.5, 1]).collect()}
    for g in ("g0", "g1", "g2", "g9"):
        assert got[g] == pytest.approx(np.quantile([v for x, v in rows if x == g and v is not None], [0, 0.1, 0.25, 0.5, 1]))
    every = S.grouped_quantiles(df, [], "v", [0.3]).collect()
    assert every[0].q == pytest.approx([np.quantile([v for _, v in rows if v is not None], 0.3)]) and S.grouped_quantiles(df.where("v > 99"), [], "v", [0.3]).count() == 0
    r = S.running(df.where("v is not null").groupBy("v").agg(F.count("*").alias("n")), ["v"], ["n"], down=True).collect()
    assert {x.v: x.n_upto for x in r} == {v: sum(1 for _, w in rows if w is not None and w >= v) for v in {w for _, w in rows if w is not None}}


@pytest.mark.parametrize("grid", sorted(match.GRIDS))
def test_threshold_grids_against_brute_force(spark, grid):
    rng = np.random.default_rng(7)
    score, y = rng.random(400), rng.random(400) < 0.4
    score[y] = np.minimum(1, score[y] + 0.2)
    kind = match.GRIDS[grid]
    cuts = np.unique(np.round(score, 3)) if kind is None else np.quantile(score, np.linspace(kind[1], kind[2], kind[3]))
    f1 = lambda t: 2 * ((score >= t) & y).sum() / ((score >= t).sum() + y.sum())
    best = max(map(f1, cuts))
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(score, y)], "score double, actual boolean")
    r = match.best_f1_on(df, grid).collect()[0]
    assert r.f1 == pytest.approx(best) and r.threshold == pytest.approx(min(t for t in cuts if f1(t) == best))


def test_command_lines(spark, sf, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "c_slice_table" in capsys.readouterr().out
    assert cli.main(["run", "nope", "--data", sf]) == 2
    assert cli.main(["run", "xml_paths", "--data", sf, "--out", str(tmp_path)]) == 0 and "has_first" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "xml_paths")).count() == 5
    assert cli.main(["folds", "--data", sf]) == 0 and "positive" in capsys.readouterr().out
