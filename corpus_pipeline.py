"""A corpus from raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linefold.llm import decontaminate, minhash, mixing, quality, suffix_dedup
from linefold.runtime import Scope, discard, materialize_at


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return minhash.one_per_group(docs, k=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 bytes that also start earlier are cut out; every document stays."""
    return suffix_dedup.strip(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages or templates of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), strict=False)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much the mix takes of each document: doc_id, size, source_size, target, taken."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: The classifier, the suffix sort and the sketches have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet once and read again; what a stage needed goes when its result stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with Scope(spark) as written:
            docs, path = materialize_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        written.discard(but=path)
        discard(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
