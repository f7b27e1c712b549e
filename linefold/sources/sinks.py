"""Result documents of any size: tasks write the JSON text, the driver only what stands between their parts.

write_result(spark, folder, {"scores": (table, ("project", "tool")), "rows": table, "note": {...}})

gives a folder whose files, read one behind the other, are one JSON document.  A section is
a list of a table's rows, or objects nested by key columns.  All files are written beside
the folder and take its place with one rename when every section stands, so a reader sees
the old document or the new one; a failed task leaves nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..runtime import ship
from .documents import plain

FLUSH = 1 << 20


def system_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+://", uri) else (fs.LocalFileSystem(), uri)


def dumped(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, allow_nan=False)


def between(before: list[str] | None, after: list[str] | None) -> str:
    """The text between rows at two paths of keys, without the last keys: closes objects, opens others; None is outside of the section."""
    a, b = ([] if p is None else p[:-1] for p in (before, after))
    same = 0
    while before is not None and after is not None and same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    out = "}" * (len(a) - same)
    if before is None:
        out += "{"
    elif after is None:
        out += "}"
    else:
        out += ","
    return out + "".join(f"{dumped(k)}:{{" for k in b[same:])


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its file, and the paths of its first and last row."""

    number: int
    file: str | None
    first: list[str] | None
    last: list[str] | None
    rows: int


class SectionWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.folder, self.name = options["path"], options["section"]
        self.keys = json.loads(options.get("keys", "[]"))
        self.rest = [c for c in columns if c not in self.keys]

    def text(self, row: Row) -> tuple[list[str] | None, str]:
        """The path of a row and its text."""
        if not self.keys:
            return None, dumped(plain(row))
        rest = {c: plain(row[c]) for c in self.rest}
        leaf = next(iter(rest.values())) if len(rest) == 1 else rest
        path = [str(row[k]) for k in self.keys]
        return path, f"{dumped(path[-1])}:{dumped(leaf)}"

    def write(self, rows: Iterator[Row]) -> Part:
        number = TaskContext.get().partitionId()
        system, folder = system_of(self.folder)
        name = f"{self.name}-{number:06d}-1-{uuid.uuid4().hex}.json"
        first = last = out = None
        held, size, n = [], 0, 0
        try:
            for row in rows:
                path, text = self.text(row)
                if out is None:
                    out, first = system.open_output_stream(f"{folder}/{name}"), path
                elif path is None:
                    text = ",\n" + text
                else:
                    text = between(last, path) + "\n" + text
                last, n = path, n + 1
                held.append(text)
                size += len(text)
                if size > FLUSH:
                    out.write("".join(held).encode())
                    held, size = [], 0
            if out is not None:
                out.write("".join(held).encode())
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(f"{folder}/{name}")
            raise
        return Part(number, name if n else None, first, last, n)

    def commit(self, messages: list[Part | None]) -> None:
        """Write what stands between the parts; files of attempts that did not count go."""
        system, folder = system_of(self.folder)
        parts = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.number)
        kept = {p.file for p in parts}
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith(f"{self.name}-") and f.base_name not in kept:
                system.delete_file(f.path)

        def put(name: str, text: str) -> None:
            with system.open_output_stream(f"{folder}/{self.name}-{name}.json") as out:
                out.write(text.encode())

        before: list[str] | None = None
        for i, p in enumerate(parts):
            put(f"{p.number:06d}-0", between(before, p.first) + "\n" if self.keys else "[\n" if i == 0 else ",\n")
            before = p.last
        end = (between(before, None) if parts else "{}") if self.keys else "\n]" if parts else "[]"
        put("999999-9", end)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = system_of(self.folder)
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"{self.name}-"):
                system.delete_file(f.path)


class JsonSection(DataSource):
    """Options: path (a folder that is there), section (the files' first name), keys (a JSON list of columns)."""

    @classmethod
    def name(cls) -> str:
        return "json_section"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SectionWriter(self.options, schema.names)


def write_result(spark: SparkSession, folder: str, sections: dict[str, DataFrame | tuple[DataFrame, tuple[str, ...]] | object]) -> None:
    """A document of named sections: tables, tables with key columns, or plain values; replaces what stands at folder.

    Rows of a section are sorted by its keys over all tasks; keys should be unique.
    """
    ship(spark)
    spark.dataSource.register(JsonSection)
    system, path = system_of(folder.rstrip("/"))
    staged = f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}"
    _, staged_path = system_of(staged)
    system.create_dir(staged_path)
    try:
        for i, (name, what) in enumerate(sections.items()):
            df, keys = what if isinstance(what, tuple) and what and isinstance(what[0], DataFrame) else (what, ())
            with system.open_output_stream(f"{staged_path}/{i:04d}-0-name.json") as out:
                out.write((("{" if i == 0 else ",\n") + dumped(name) + ":").encode())
            if not isinstance(df, DataFrame):
                with system.open_output_stream(f"{staged_path}/{i:04d}-1-value.json") as out:
                    out.write(dumped(plain(df)).encode())
                continue
            if keys:
                df = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
            df.write.format("json_section").option("path", staged).option("section", f"{i:04d}-1").option("keys", json.dumps(list(keys))).mode("append").save()
        with system.open_output_stream(f"{staged_path}/9999-end.json") as out:
            out.write(b"}\n" if sections else b"{}\n")
        old = f"{path}.old-{uuid.uuid4().hex}"
        there = system.get_file_info(path).type != fs.FileType.NotFound
        if there:
            system.move(path, old)
        system.move(staged_path, path)
        if there:
            system.delete_dir(old)
    except BaseException:
        if system.get_file_info(staged_path).type != fs.FileType.NotFound:
            system.delete_dir(staged_path)
        raise


def document_text(folder: str) -> Iterator[bytes]:
    """The document, file by file."""
    system, path = system_of(folder)
    for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.base_name):
        with system.open_input_stream(f.path) as s:
            while data := s.read(FLUSH):
                yield data


def read_document(folder: str) -> object:
    """A small document as a value."""
    return json.loads(b"".join(document_text(folder)))
