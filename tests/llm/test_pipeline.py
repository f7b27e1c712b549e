"""The pipeline against brute force on a small table, and its behaviour on odd input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from linefold.llm import quality  # noqa: E402

from .test_corpus import ITEM, bench, brute_near, brute_removed, frame  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    base = "the stone of the river was in the old town and then it went over to the hills again with all of them"
    texts = [(1, base), (2, base + " end"), (3, "other words of plain prose that are by no means alike, and so on"), (4, ITEM + " and more of it")]
    texts += [(5, "start one " + "y" * 150), (6, "start two here " + "y" * 150 + " tail é"), (7, None)]
    docs = frame(spark, texts).withColumnRenamed("lang", "d")  # a name that the operators use inside
    bench(spark, [ITEM]).write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_filter", "near_duplicates", "repeated_strings", "benchmark_leaks", "source_mix"]
    near = stages["near_duplicates"](spark, docs, str(tmp_path))
    _, root = brute_near(texts, 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, _ in texts if root[i] == i) and near.columns == docs.columns
    cut = stages["repeated_strings"](spark, near, str(tmp_path))
    got = {r.doc_id: r for r in cut.collect()}
    want = brute_removed([(i, t) for i, t in texts if root[i] == i], 100)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    for i, r in got.items():
        assert len(r.text.encode()) == want[i][0] - want[i][1] and r.n_chars == len(r.text)
    clean = stages["benchmark_leaks"](spark, cut, str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == [1, 3, 5, 6, 7] and clean.columns == docs.columns
    mixed = stages["source_mix"](spark, clean, str(tmp_path)).collect()
    assert sum(r.taken for r in mixed) == sum(r["size"] for r in mixed)


def test_run_and_classifier(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    kept = corpus_pipeline.quality_filter(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r.doc_id for r in out} <= good and len({r.doc_id for r in out}) == len(out)


def test_empty_and_repeated_rows(spark):
    sf = "/root/testdata/sf0.001"
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    t = "one two three four five six seven eight nine ten"
    twice = frame(spark, [(1, t), (1, t), (None, t), (None, None)])
    got = corpus_pipeline.near_duplicates(spark, twice, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None", "None"]


CLASHES = ["d", "k1", "k2", "bands", "bits", "cid", "h", "ctx", "runs", "whole", "rest", "size", "target", "n", "text_", "codes", "score", "held_out", "src_key", "cell", "bad_id", "record_id", "sha", "len", "linefold_pad"]


def test_extra_columns_with_clashing_names(spark, tmp_path):
    from pyspark.sql import functions as F

    from linefold.llm import license_scan, mixing, tiff_media, token_count, warc
    from linefold.llm import decontaminate, html_extract, minhash, suffix_dedup

    texts = [(1, "a b c d e f g " * 30), (2, "a b c d e f g " * 30), (3, None), (4, "Released under the MIT License.")]
    plain = frame(spark, texts)
    wide = plain.select("*", *[F.lit(7).alias(c) for c in CLASHES])
    items = bench(spark, [ITEM])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    runs = [
        lambda x: license_scan.scan(x).drop("spans"), lambda x: token_count.count(x, "byte_bpe_50k.json"), tiff_media.describe, suffix_dedup.report, lambda x: minhash.near_duplicates(x, k=2),
        lambda x: quality.score(x, labels), lambda x: mixing.mix(x).drop("takes"), lambda x: decontaminate.find(x, items),
    ]
    for run in runs:
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(plain).collect()))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        assert all(r.k1 == 7 and r.linefold_pad == 7 for r in out.collect())
    pages = spark.createDataFrame([(1, "u", "<p>x</p>" * 200)], "page_id bigint, url string, html string")
    more = pages.select("*", *[F.lit(7).alias(c) for c in CLASHES])
    assert html_extract.extract(more).collect() == html_extract.extract(pages).collect()
    assert warc.read_archive(warc.write_archive(more)).collect() == warc.read_archive(warc.write_archive(pages)).collect()
