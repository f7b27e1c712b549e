"""The thin queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hard_negatives, html_extract, language_id, license_scan, minhash, mixing, quality, ranked_search, suffix_dedup, tiff_media, token_count, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_archive(warc.write_archive(pages)).drop("url")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.describe(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), strict=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80).drop("n_links")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_html_extract, op2_decontaminate, op3_license_scan, op4_mixing, op5_warc, op6_token_count, op7_tiff_media, op8_suffix_dedup, op9_quality, op10_minhash, op11_language_id, op12_hard_negatives, op13_ranked_search)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.ORACLE,
        "op8_suffix_dedup": suffix_dedup.ORACLE,
        "op10_minhash": minhash.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
        "op13_ranked_search": ranked_search.ORACLE,
        "op5_warc": """
            WITH r AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS len, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
            b AS (SELECT *, max(page_id) OVER (PARTITION BY sha, len) AS top FROM r)
            SELECT page_id, CAST(len AS BIGINT) AS payload_bytes, sha AS payload_digest,
                   CASE WHEN len >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN len >= 1000 AND page_id <> top THEN top END AS refers_to
            FROM b""",
    }
