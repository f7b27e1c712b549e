"""Members of archives and tables in folders, by suffix; ARFF tables; downloads that go on where they stopped."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
import tarfile
import time
import urllib.error
import urllib.request
import zipfile
import zlib
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from . import zipped

MEMBERS = "archive string, member string, content binary, sha256 string, length bigint, error string"
_NAMES = ["archive", "member", "content", "sha256", "length", "error"]
_TYPES = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]


def members(data: bytes, name: str, wanted: tuple[str, ...], max_bytes: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(member, content, error) of the files in a zip, tar (plain or packed) or gzip file whose base name fits a pattern.

    A member that leaves the archive's folder or is larger than max_bytes has an error
    instead of its content; one that is read is read alone.
    """
    fits = lambda m: any(fnmatch(m.rsplit("/", 1)[-1].lower(), w.lower()) for w in wanted)
    strays = lambda m: m.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", m)

    def bounded(stream: io.BufferedIOBase) -> tuple[bytes | None, str | None]:
        content = stream.read(max_bytes + 1)
        return (None, f"larger than {max_bytes} bytes") if len(content) > max_bytes else (content, None)

    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir() and fits(m.filename):
                    if strays(m.filename):
                        yield m.filename, None, "leaves the archive"
                        continue
                    with z.open(m) as f:
                        yield m.filename, *bounded(f)
    elif low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and fits(m.name):
                    yield (m.name, None, "leaves the archive") if strays(m.name) else (m.name, *bounded(t.extractfile(m)))
    elif low.endswith(".gz"):
        own = name.rsplit("/", 1)[-1][:-3]
        if fits(own):
            with gzip.open(io.BytesIO(data)) as f:
                yield own, *bounded(f)
    else:
        raise ValueError("not a zip, tar or gzip file")


def read_archives(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("*",), max_bytes: int = 1 << 28) -> DataFrame:
    """(archive, member, content, sha256, length, error): a row per fitting member of all archives below a folder.

    Members are dealt over tasks by their place in the archive, see zipped; damaged archives
    give one row with the error and those members that could be read.
    """
    ship(spark)
    names = zipped.archive_files(spark, path)
    if not names or not zipped.readable(names[0]):
        return _read_whole(spark, path, wanted, max_bytes)
    chunks = zipped.read_chunks(spark, path, wanted, chunk_bytes=max_bytes + 1, split_bytes=max_bytes + 1, max_bytes=max_bytes)
    return chunks.select("archive", "member", F.col("data").alias("content"), F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("bigint").alias("length"), "error")


def _read_whole(spark: SparkSession, path: str, wanted: tuple[str, ...], max_bytes: int) -> DataFrame:
    """As read_archives() for a store that only Spark reads: a task holds an archive, at most 2 GB as Spark's binary files are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,tar,gz,tgz,bz2,xz}").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    for name, content, error in members(data.as_py(), at, wanted, max_bytes):
                        yield one(at, name, content, hashlib.sha256(content).hexdigest() if content is not None else None, len(content) if content is not None else None, error)
                except (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error, RuntimeError, NotImplementedError) as e:
                    yield one(at, None, None, None, None, f"{type(e).__name__}: {e}")

    return files.mapInArrow(run, MEMBERS)


#: Readers of table files by suffix.
TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".parquet": lambda s, p: s.read.parquet(p),
    ".csv": lambda s, p: s.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(p),
    ".tsv": lambda s, p: s.read.option("header", "true").option("sep", "\t").csv(p),
    ".jsonl": lambda s, p: s.read.json(p),
    ".json": lambda s, p: s.read.option("multiLine", "true").json(p),
    ".arff": lambda s, p: read_arff(s, p),
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table file by its suffix."""
    for suffix, reader in TABLES.items():
        if path.lower().rstrip("/").endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no table reader for {path}; there are {', '.join(TABLES)}")


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder that read_table() takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in TABLES) + ")$"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """A dense ARFF file: numeric attributes as double, the others as string; ? is null."""
    head = []
    # the header ends at @data; its lines are as many as attributes, comments and blanks
    for r in spark.read.text(path).limit(10_000).toLocalIterator():
        head.append(r.value)
        if r.value.strip().lower().startswith("@data"):
            break
    attr = [m for m in (re.match(r"\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)", x, re.I) for x in head) if m]
    fields = [T.StructField(m[1].strip("'\""), T.DoubleType() if re.match(r"(numeric|real|integer)\b", m[2].strip(), re.I) else T.StringType()) for m in attr]
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(@|%|$)"))
    parsed = rows.select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(fields))), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return parsed.select(*[F.when(F.col(f"r.c{i}") != "?", F.col(f"r.c{i}")).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


#: Where the files of a hosted dataset are, by the kind of host.
HOSTS = {
    "github": "https://github.com/{id}/archive/refs/heads/{branch}.zip",
    "zenodo": "https://zenodo.org/records/{id}/files/{file}?download=1",
    "openml": "https://www.openml.org/data/download/{id}/{file}",
    "kaggle": "https://www.kaggle.com/api/v1/datasets/download/{id}",
    "gdrive": "https://drive.google.com/uc?export=download&id={id}",
    "url": "{id}",
}


def address(kind: str, ident: str, file: str = "", branch: str = "main") -> str:
    if kind not in HOSTS:
        raise ValueError(f"no host {kind}; there are {', '.join(HOSTS)}")
    return HOSTS[kind].format(id=ident, file=file, branch=branch)


def download(url: str, path: str, tries: int = 4, wait: float = 0.5, block: int = 1 << 20) -> int:
    """Fetch url into path and give its size; a part that is there already is continued.

    206 continues, 200 begins anew, 416 means that all is there; failures wait twice as long
    each time.  The part lies beside the file and takes its name when complete.
    """
    part = f"{path}.part"
    for n in range(tries):
        have = os.path.getsize(part) if os.path.exists(part) else 0
        ask = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        try:
            with urllib.request.urlopen(ask, timeout=60) as r, open(part, "ab" if r.status == 206 else "wb") as out:
                due = r.headers.get("Content-Length")
                got = 0
                while data := r.read(block):
                    out.write(data)
                    got += len(data)
                if due is not None and got < int(due):
                    raise OSError(f"{got} of {due} bytes")
            break
        except urllib.error.HTTPError as e:
            if e.code == 416 and have:
                break
            if e.code < 500 or n + 1 == tries:
                raise
        except OSError:
            if n + 1 == tries:
                raise
        time.sleep(wait * 2**n)
    os.replace(part, path)
    return os.path.getsize(path)
