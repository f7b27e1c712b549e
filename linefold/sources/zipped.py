"""Archives by byte ranges: a data source whose tasks read their part of an archive, planned from its directory.

A zip's directory stands at its end and a plain tar's headers between its members, so the
plan reads those alone.  A member that is stored is split into ranges; one that is packed is
one task's stream, with no more than a chunk of it in memory; small members share a task.
Packed tars and gzip files have no directory and are a stream each.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import ship

CHUNKS = "archive string, member string, chunk bigint, offset bigint, size bigint, data binary, error string"
_SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("chunk", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), ("error", pa.string())])
#: What a damaged archive raises.
DAMAGE = (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, struct.error)


def opened(uri: str) -> pa.NativeFile:
    """A file that can be read at any place, on any file system that the libraries know."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    system, path = fs.FileSystem.from_uri(uri) if re.match(r"\w+://", uri) else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


def fits(member: str, wanted: list[str]) -> bool:
    return any(fnmatch(member.rsplit("/", 1)[-1].lower(), w.lower()) for w in wanted)


def strays(member: str) -> bool:
    return member.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", member)


@dataclass(frozen=True)
class Piece:
    """Bytes start to end of a member whose content begins at ``at`` in the archive (zip: its local header)."""

    archive: str
    member: str = ""
    kind: str = "stored"
    at: int = 0
    packed: int = 0
    size: int = 0
    start: int = 0
    end: int = 0
    crc: int | None = None
    error: str | None = None


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces


def plan(archive: str, wanted: list[str], chunk: int, split: int) -> Iterator[Piece]:
    """The pieces of an archive; split is a multiple of chunk."""
    low = archive.lower()
    if not low.endswith((".zip", ".tar")):
        yield Piece(archive, kind="stream")
        return
    try:
        with opened(archive) as f:
            if low.endswith(".zip"):
                methods = {zipfile.ZIP_STORED: "zip stored", zipfile.ZIP_DEFLATED: "zip deflate", zipfile.ZIP_BZIP2: "zip bz2", zipfile.ZIP_LZMA: "zip lzma"}
                every = [(m.filename, "encrypted" if m.flag_bits & 1 else methods.get(m.compress_type, f"method {m.compress_type}"), m.header_offset, m.compress_size, m.file_size, m.CRC) for m in zipfile.ZipFile(f).infolist() if not m.is_dir()]
            else:
                every = []
                with tarfile.open(fileobj=f, mode="r:") as t:
                    for m in t:
                        if m.isfile():
                            every.append((m.name, "stored" if not m.issparse() else "sparse file", m.offset_data, m.size, m.size, None))
    except DAMAGE as e:
        yield Piece(archive, error=f"{type(e).__name__}: {e}")
        return
    for name, kind, at, packed, size, crc in every:
        if not fits(name, wanted):
            continue
        error = "leaves the archive" if strays(name) else None if kind.startswith("zip ") or kind == "stored" else f"cannot be read: {kind}"
        step = split if kind in ("stored", "zip stored") and not error else max(1, size)
        for start in range(0, max(1, size), step):
            yield Piece(archive, name, kind, at, packed, size, start, min(size, start + step), crc, error)


def dealt(pieces: Iterator[Piece], split: int) -> Iterator[Pieces]:
    """Small pieces of an archive together, up to about split bytes a task."""
    held: list[Piece] = []
    weight = 0
    for p in pieces:
        held.append(p)
        weight += max(4096, p.end - p.start)
        if weight >= split or p.kind == "stream":
            yield Pieces(held)
            held, weight = [], 0
    if held:
        yield Pieces(held)


def inflated(f: pa.NativeFile, left: int, kind: str, chunk: int) -> Iterator[bytes]:
    """The content of a packed member in parts of at most chunk bytes, however well it is packed."""
    if kind == "zip lzma":
        head = f.read(4)
        filters = [lzma._decode_filter_properties(lzma.FILTER_LZMA1, f.read(n := struct.unpack("<H", head[2:])[0]))]
        left -= 4 + n
        d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters)
    elif kind == "zip bz2":
        d = bz2.BZ2Decompressor()
    else:
        d = zlib.decompressobj(-15)
    data = b""
    while True:
        if kind == "zip deflate":
            data = d.unconsumed_tail
        if not data and left and (kind == "zip deflate" or d.needs_input):
            data = f.read(min(left, 1 << 18))
            left -= len(data)
            if not data:
                raise EOFError("the archive ends inside the member")
        out = d.decompress(data, chunk)
        data = b""
        if out:
            yield out
        if d.eof:
            return
        if not out and not left and not (kind == "zip deflate" and d.unconsumed_tail):
            raise EOFError("the member ends too early")


def content(p: Piece, chunk: int) -> Iterator[bytes]:
    """The bytes of a piece."""
    with opened(p.archive) as f:
        f.seek(p.at)
        if p.kind.startswith("zip "):
            head = f.read(30)
            if len(head) < 30 or head[:4] != b"PK\3\4":
                raise zipfile.BadZipFile(f"no member begins at {p.at}")
            f.seek(p.at + 30 + sum(struct.unpack("<HH", head[26:30])))
        if p.kind in ("stored", "zip stored"):
            f.seek(f.tell() + p.start)
            left = p.end - p.start
            while left:
                data = f.read(min(left, chunk))
                if not data:
                    raise EOFError("the archive ends inside the member")
                left -= len(data)
                yield data
        else:
            yield from inflated(f, p.packed, p.kind, chunk)


def even(parts: Iterator[bytes], chunk: int) -> Iterator[bytes]:
    """The same bytes in parts of chunk bytes, the last one shorter."""
    held = bytearray()
    for p in parts:
        held += p
        while len(held) >= chunk:
            yield bytes(held[:chunk])
            del held[:chunk]
    if held:
        yield bytes(held)


def streamed(archive: str, wanted: list[str], chunk: int, most: int) -> Iterator[tuple]:
    """Rows of an archive without a directory; members longer than most give an error after their first bytes."""
    low = archive.lower()
    with opened(archive) as f:
        if low.endswith((".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
            with tarfile.open(fileobj=f, mode="r|*") as t:
                for m in t:
                    if not m.isfile() or not fits(m.name, wanted):
                        continue
                    if strays(m.name):
                        yield archive, m.name, None, None, None, None, "leaves the archive"
                    elif m.size > most:
                        yield archive, m.name, None, None, m.size, None, f"larger than {most} bytes"
                    else:
                        yield from rows_of(archive, m.name, _reads(t.extractfile(m), chunk), chunk, m.size)
        elif low.endswith((".gz", ".bz2", ".xz")):
            own, suffix = archive.rsplit("/", 1)[-1].rsplit(".", 1)
            if fits(own, wanted):
                opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[suffix.lower()]
                with opener(f) as s:
                    yield from rows_of(archive, own, _reads(s, chunk), chunk, None, most)
        else:
            raise ValueError("not a zip, tar, gzip, bzip2 or xz file")


def _reads(stream: object, chunk: int) -> Iterator[bytes]:
    while data := stream.read(chunk):
        yield data


def rows_of(archive: str, member: str, parts: Iterator[bytes], chunk: int, size: int | None, most: int | None = None, start: int = 0) -> Iterator[tuple]:
    offset = start
    for data in even(parts, chunk):
        if most is not None and offset + len(data) > most:
            yield archive, member, None, None, None, None, f"larger than {most} bytes"
            return
        yield archive, member, offset // chunk, offset, size, data, None
        offset += len(data)
    if offset == start == 0:
        yield archive, member, 0, 0, 0, b"", None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.archives = json.loads(options["archives"])
        self.wanted = json.loads(options.get("wanted", '["*"]'))
        self.chunk = int(options.get("chunkbytes", options.get("chunkBytes", 4 << 20)))
        split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.split = max(1, split // self.chunk) * self.chunk
        self.most = int(options.get("maxbytes", options.get("maxBytes", 1 << 62)))

    def partitions(self) -> list[InputPartition]:
        return [part for a in self.archives for part in dealt(plan(a, self.wanted, self.chunk, self.split), self.split)] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for p in partition.pieces:
            try:
                for row in self.rows(p):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)
            except DAMAGE as e:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((p.archive, p.member or None, None, None, None, None, f"{type(e).__name__}: {e}"), _SCHEMA, strict=True)], schema=_SCHEMA)

    def rows(self, p: Piece) -> Iterator[tuple]:
        if p.kind == "stream":
            yield from streamed(p.archive, self.wanted, self.chunk, self.most)
            return
        error = p.error or (f"larger than {self.most} bytes" if p.size > self.most else None)
        if error:
            if p.start == 0:
                yield p.archive, p.member or None, None, None, None, None, error
            return
        crc = 0

        def checked() -> Iterator[bytes]:
            nonlocal crc
            for data in content(p, self.chunk):
                crc = zlib.crc32(data, crc)
                yield data

        whole = p.start == 0 and p.end == p.size and p.crc is not None
        yield from rows_of(p.archive, p.member, checked(), self.chunk, p.size, start=p.start)
        if whole and crc != p.crc:
            raise zipfile.BadZipFile("the content does not fit its checksum")


class ArchiveChunks(DataSource):
    """Options: archives and wanted (JSON lists), chunkBytes, splitBytes, maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: object) -> DataSourceReader:
        return ArchiveReader(self.options)


def readable(uri: str) -> bool:
    """Whether tasks can open such an address themselves; a store that only Spark reads is none."""
    try:
        opened(uri).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError):
        return False
    except OSError:
        pass  # an error row will say so
    return True


def archive_files(spark: SparkSession, path: str) -> list[str]:
    """The archives below a folder: a list of names, not of contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,tar,gz,tgz,bz2,xz}").load(path).select("path")
    return sorted(r["path"] for r in files.toLocalIterator())


def read_chunks(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("*",), chunk_bytes: int = 4 << 20, split_bytes: int = 64 << 20, max_bytes: int = 1 << 62) -> DataFrame:
    """(archive, member, chunk, offset, size, data, error): the members of all archives below a folder, in chunks.

    size is the member's (null for a stream that does not say); an error row has no data.
    """
    ship(spark)
    spark.dataSource.register(ArchiveChunks)
    source = spark.read.format("archive_chunks").option("archives", json.dumps(archive_files(spark, path))).option("wanted", json.dumps(list(wanted)))
    return source.option("chunkBytes", str(chunk_bytes)).option("splitBytes", str(split_bytes)).option("maxBytes", str(max_bytes)).load()


def read_lines(chunks: DataFrame) -> DataFrame:
    """(archive, member, chunk, line_idx, line) of the chunks' text: a line belongs to the chunk in which it begins.

    A chunk gives its whole lines; the piece behind its last line end goes on with the
    pieces of the chunks up to the next line end, which are found by a window of the
    chunks' ends alone, not of their lines.
    """
    text = F.decode("data", "iso-8859-1")  # bytes as characters, so that a character across two chunks stays whole
    parts = chunks.where("error IS NULL").select("archive", "member", "chunk", F.split(text, "\n", -1).alias("p"))
    n = F.size("p")
    ends = parts.select("archive", "member", "chunk", F.get("p", F.lit(0)).alias("head"), F.element_at("p", -1).alias("tail"), (n > 1).alias("breaks"))
    w = Window.partitionBy("archive", "member").orderBy("chunk")
    # chunks up to the next one that breaks a line continue the open piece
    run = ends.withColumn("run", F.sum(F.col("breaks").cast("bigint")).over(w))
    joins = run.select("archive", "member", F.when(F.col("breaks"), F.col("run") - 1).otherwise(F.col("run")).alias("run"), "chunk", "breaks", F.col("head").alias("piece"))
    rest = joins.groupBy("archive", "member", "run").agg(F.max("breaks").alias("closed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "").alias("rest"))
    # run 0 is what stands before the first line end: a line of its own
    first = rest.where("run = 0 AND (closed OR rest <> '')").select("archive", "member", F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).alias("line_idx"), F.col("rest").alias("line"))
    opened_at = run.where("breaks").select("archive", "member", "run", "chunk", "tail").join(rest, ["archive", "member", "run"], "left").where("tail <> '' OR rest IS NOT NULL")
    last = opened_at.select("archive", "member", "chunk", F.lit(1 << 30).alias("line_idx"), F.concat("tail", F.coalesce("rest", F.lit(""))).alias("line"))
    middle = parts.where(n > 2).select("archive", "member", "chunk", F.posexplode(F.slice("p", F.lit(2), n - 2)).alias("line_idx", "line"))
    every = first.unionByName(middle.select("archive", "member", "chunk", "line_idx", "line")).unionByName(last)
    return every.select("archive", "member", "chunk", "line_idx", F.decode(F.encode("line", "iso-8859-1"), "utf-8").alias("line"))
