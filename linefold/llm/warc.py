"""WARC archives as a chunked record table.

A record never sits in memory as a whole: it is a run of rows (record id, chunk number,
bytes), each row with the digest of the payload up to its end.  Joining the bytes of a
record's rows in chunk order gives a valid compressed WARC/1.1 record: each chunk is a gzip
member, as in .warc.gz files.  The table is Parquet in the
shared folder, so that losing an executor loses nothing, and reading it back streams the
chunks through one running SHA-1 per record.

Defined cases: null html is an empty payload; page_id and url may be null (written as an
empty header); repeated rows give a record each; an empty table gives an empty archive.
Of equal payloads with one page_id twice, the row with the smaller record id is the
response.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship

CHUNK = 1 << 18
#: The date of records where none is given, so that runs agree.
DATE = "1970-01-01T00:00:00Z"
#: Repeated payloads up to which their table is broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 100_000
CHUNK_SCHEMA = "record_id bigint, page_id bigint, chunk_no int, header_bytes int, body binary, payload_end bigint, running_sha1 string, last boolean"
_KINDS = [("record_id", pa.int64()), ("page_id", pa.int64()), ("chunk_no", pa.int32()), ("header_bytes", pa.int32()), ("body", pa.binary()), ("payload_end", pa.int64()), ("running_sha1", pa.string()), ("last", pa.bool_())]


def record_uri(record_id: int) -> str:
    """The record's URI, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'linefold record {record_id}')}>"


def header_of(record_id: int, page_id: int | None, url: str | None, kind: str, length: int, digest: str, refers_to: tuple[int, int | None] | None, date: str = DATE) -> bytes:
    """refers_to: record and page of the response that a revisit stands for."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    shown = lambda x: "" if x is None else x
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_uri(record_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Linefold-Page-ID: {shown(page_id)}",
        f"Linefold-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        record, page = refers_to
        lines += [f"WARC-Refers-To: {record_uri(record)}", f"Linefold-Refers-To-Page: {shown(page)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {0 if kind == 'revisit' else length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(data: bytes) -> dict[str, str]:
    head = data.decode("utf-8").split("\r\n")
    if head[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head[1:] if x)}


def plan_records(pages: DataFrame, min_revisit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Pages with record id, payload length and SHA-1; and per repeated payload the page and record that is the response."""
    src = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    ids = src.agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("u")).collect()[0]
    if ids["n"] == ids["u"]:
        # a page's own number names its record, whichever run or stage computes it
        src = src.withColumn("record_id", F.col("page_id"))
    else:
        # numbers that a stage gives out are written once: a second run could deal rows another way
        src = materialize(src.withColumn("record_id", F.monotonically_increasing_id()), "warc-pages")
    rows = src.select("page_id", "url", "html", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").cast("bigint").alias("len"), "record_id")
    key = rows.select("sha", "len", "page_id", "record_id").where(F.col("len") >= min_revisit)
    # one row per payload: the aggregation folds a hot payload on the map side
    best = key.groupBy("sha", "len").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), (-F.col("record_id")).alias("r"))).alias("b"), F.count("*").alias("n"))
    best = best.where("n > 1").select(F.col("sha").alias("b_sha"), F.col("len").alias("b_len"), F.col("b.p").alias("b_page"), (-F.col("b.r")).alias("b_record"))
    return rows, best


def write_archive(pages: DataFrame, min_revisit: int = 1000, chunk: int = CHUNK, date: str = DATE) -> DataFrame:
    """Write every page as a record of one date; gives the chunk table as read back from storage."""
    ship(pages.sparkSession)
    rows, best = plan_records(pages, min_revisit)
    # few payloads repeat: their table is broadcast if counted small, so that pages are not shuffled
    best = materialize(best, "warc-repeats")
    best = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    j = rows.join(best, (F.col("sha") == F.col("b_sha")) & (F.col("len") == F.col("b_len")), "left").select(
        "record_id", "page_id", "url", "html", "sha", "len",
        F.when(F.col("b_record").isNotNull() & (F.col("b_record") != F.col("record_id")), "revisit").otherwise("response").alias("kind"), "b_page", "b_record",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(9)]
            rows: list[tuple] = []
            size = 0
            for i in range(b.num_rows):
                rid, pid, url, digest, length, kind, page, record = (cols[c][i].as_py() for c in (0, 1, 2, 4, 5, 6, 7, 8))
                # null page ids sort below all others
                ref = None if kind == "response" else (record, None if page == -(2**63) else page)
                head = header_of(rid, pid, url, kind, length, digest, ref, date)
                payload = memoryview(cols[3][i].as_buffer()) if kind == "response" else memoryview(b"")
                n, at, no, sha = len(payload), 0, 0, hashlib.sha1()
                while True:
                    part = payload[at : at + chunk]
                    sha.update(part)
                    at += len(part)
                    last = at >= n
                    body = gzip.compress((head if no == 0 else b"") + bytes(part) + (b"\r\n\r\n" if last else b""), 6, mtime=0)
                    rows.append((rid, pid, no, len(head) if no == 0 else 0, body, at, sha.hexdigest() if kind == "response" else digest, last))
                    size += len(body)
                    no += 1
                    if size >= 8 * chunk:
                        yield _batch(rows)
                        rows, size = [], 0
                    if last:
                        break
            if rows:
                yield _batch(rows)

    return materialize(j.mapInArrow(run, CHUNK_SCHEMA), "warc")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])


def read_archive(chunks: DataFrame) -> DataFrame:
    """One row per record, from the stored bytes: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Chunks of a record meet in one task and stream through one hash; a stored digest that
    differs from the one of the bytes raises.
    """
    ship(chunks.sparkSession)
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select("record_id", "chunk_no", "header_bytes", "body", "running_sha1", "last").repartition(n, "record_id").sortWithinPartitions("record_id", "chunk_no")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict[str, str] = {}
        sha, size = hashlib.sha1(), 0
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                no, hb, last = b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(5)[i].as_py()
                body = memoryview(gzip.decompress(b.column(3)[i].as_buffer()))
                if no == 0:
                    head, sha, size = parse_header(bytes(body[:hb])), hashlib.sha1(), 0
                part = body[hb : len(body) - 4 if last else len(body)]
                sha.update(part)
                size += len(part)
                stored = b.column(4)[i].as_py()
                kind = head["warc-type"]
                if kind == "response" and sha.hexdigest() != stored:
                    raise ValueError(f"record {b.column(0)[i].as_py()}: digest of chunk {no} differs")
                if last:
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    length = int(head["linefold-payload-length"])
                    if size != int(head["content-length"]) or (kind == "response" and (digest != sha.hexdigest() or size != length)):
                        raise ValueError("record length or digest differs")
                    as_int = lambda x: int(x) if x else None
                    out.append((as_int(head["linefold-page-id"]), head["warc-target-uri"], length, digest, kind, as_int(head.get("linefold-refers-to-page"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return dealt.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
