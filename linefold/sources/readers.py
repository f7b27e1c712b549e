"""Readers and writers: tolerant JSON lines, Parquet, source files, manifests, schema gate, profiles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import simple_name

FUNCTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("CVE ID", "CVE Page", "CWE ID", "codeLink", "commit_id", "commit_message", "func_after", "func_before", "lang", "project", "vul")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = FUNCTIONS) -> DataFrame:
    """JSON lines; blank and unreadable lines are skipped, bad bytes replaced, row_pos is the place in input order.

    row_pos comes from the order of files and splits, so it grows with the input but has gaps.
    """
    text = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    rows = text.select(F.monotonically_increasing_id().alias("row_pos"), F.from_json("value", _with_marker(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r is not null and r._bad is null").select("row_pos", "r.*").drop("_bad")


def _with_marker(schema: T.StructType | str) -> T.StructType:
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([*s.fields, T.StructField("_bad", T.StringType())])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sources(spark: SparkSession, path: str, suffixes: str = "*.{c,h}") -> DataFrame:
    """(path, content, code, sha256, length) of all matching files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(path)
    return files.select("path", "content", F.decode("content", "UTF-8").alias("code"), F.sha2("content", 256).alias("sha256"), "length")


def read_external_slices(spark: SparkSession, path: str) -> DataFrame:
    """(file, method, seeds, lines): of several methods of a file, the one with most lines."""
    rows = spark.read.schema("file string, method string, seeds int, lines array<int>").json(path)
    base = F.element_at(F.split("file", "/"), -1)
    best = rows.groupBy(base.alias("file")).agg(F.max(F.struct(F.size("lines").alias("n"), "method", "seeds", "lines")).alias("b"))
    return best.select("file", "b.method", "b.seeds", "b.lines")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A result document (one JSON object) as (name, value) of its numeric leaves."""
    text = spark.read.option("wholetext", "true").text(path)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out: list[tuple[str, float]] = []

            def walk(x: object, name: str) -> None:
                if isinstance(x, dict):
                    for k, v in x.items():
                        walk(v, f"{name}.{k}" if name else k)
                elif isinstance(x, list):
                    for i, v in enumerate(x):
                        walk(v, f"{name}[{i}]")
                elif isinstance(x, int | float) and not isinstance(x, bool):
                    out.append((name, float(x)))

            for v in b["value"]:
                walk(json.loads(v), "")
            yield pd.DataFrame(out, columns=["name", "value"])

    return text.mapInPandas(leaves, "name string, value double")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; sets go as sorted arrays."""
    cols = [F.array_sort(c.name).alias(c.name) if isinstance(c.dataType, T.ArrayType) and not isinstance(c.dataType.elementType, T.MapType) else F.col(f"`{c.name}`") for c in df.schema]
    df.select(*cols).write.mode(mode).json(path)


def append_fold(df: DataFrame, path: str, fold: int) -> None:
    """Checkpoint of one fold: replaces that fold's partition only."""
    df.withColumn("fold", F.lit(fold)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


#: Readers by source type; offline kinds only.
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {"jsonl": read_jsonl, "parquet": read_parquet, "sources": read_sources, "slices": read_external_slices, "result": read_result}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    if kind not in REGISTRY:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](spark, path)


def best_split(files: DataFrame) -> DataFrame:
    """files(dataset, split, path): one split per dataset, test before validation, valid and train."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("test", "validation", "valid", "train"))), F.col("split")), F.lit(0))
    return files.groupBy("dataset").agg(F.min(F.struct(F.when(rank == 0, 99).otherwise(rank).alias("r"), "split", "path")).alias("b")).select("dataset", "b.split", "b.path")


def resolve(names: DataFrame, wanted: Column) -> Column:
    """Whether a manifest name is meant: equal but for case and punctuation, or either part of the other."""
    a, b = simple_name(names["name"]), simple_name(wanted)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def schema_gate(columns: DataFrame, markers: DataFrame, required: DataFrame) -> DataFrame:
    """columns(dataset, col), markers(modality, prio, marker), required(modality, need, alias) ->
    (dataset, modality, hits, missing): the modality of most marker hits, ties by priority, and what it lacks.
    """
    have = columns.select("dataset", simple_name(F.col("col")).alias("c")).distinct()
    hits = have.join(markers.select("modality", "prio", F.col("marker").alias("c")), "c").groupBy("dataset", "modality", "prio").agg(F.count("*").alias("hits"))
    best = hits.groupBy("dataset").agg(F.max(F.struct("hits", (-F.col("prio")).alias("p"), "modality")).alias("b")).select("dataset", "b.modality", "b.hits")
    asked = best.join(required, "modality")
    met = asked.join(have.withColumnRenamed("c", "alias"), ["dataset", "alias"], "left_semi").select("dataset", "need").distinct()
    lack = asked.select("dataset", "need").distinct().join(met, ["dataset", "need"], "left_anti").groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list("need")), ",").alias("missing"))
    out = columns.select("dataset").distinct().join(best, "dataset", "left").join(lack, "dataset", "left")
    return out.select("dataset", F.coalesce("modality", F.lit("unknown")).alias("modality"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), F.coalesce("missing", F.lit("")).alias("missing"))


def verify_fingerprints(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files(path, sha256), expected(path, sha256) -> (path, status): ok, changed, missing or extra."""
    a, b = files.select("path", F.col("sha256").alias("got")), expected.select("path", F.col("sha256").alias("want"))
    s = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("got") == F.col("want"), "ok").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", s.alias("status"))


def profile_row(line: str) -> dict | None:
    """One line of a profile listing: comma-separated, commas inside braces do not count; None for lines that are none."""
    if not line.strip() or line.startswith("Time is"):
        return None
    parts, depth, cur = [], 0, ""
    for c in line.strip():
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    parts.append(cur)
    if len(parts) < 8:
        return None
    inner = lambda s: s[s.find("{") + 1 : s.rfind("}")] if "{" in s else ""
    ints = lambda s: sorted({int(x) for x in re.findall(r"-?\d+", inner(s))})
    names = lambda s: sorted({x.strip() for x in inner(s).split(",") if x.strip()})
    calls = {m[1]: int(m[2]) for m in re.finditer(r"([\w:.]+)\{(\d+)\}", inner(parts[7]))}
    return {"function": parts[1].strip(), "variable": parts[2].strip(), "def": ints(parts[3]), "use": ints(parts[4]), "dvars": names(parts[5]), "pointers": names(parts[6]), "cfuncs": calls}


def parse_profiles(rows: DataFrame, text_col: str = "value") -> DataFrame:
    """function, variable, def, use, dvars, pointers, cfuncs from profile listings, a line per row."""
    from ..runtime import ship

    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for x in map(profile_row, b["value"]) if x]
            yield pd.DataFrame(found, columns=["function", "variable", "def", "use", "dvars", "pointers", "cfuncs"])

    return rows.select(F.col(text_col).alias("value")).where("value is not null").mapInPandas(run, "function string, variable string, def array<int>, use array<int>, dvars array<string>, pointers array<string>, cfuncs map<string,int>")


def pair_functions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(commit, file, name, func_before, func_after) of functions whose text changed; equal pairs once.

    before, after: (commit, file, name, code).
    """
    keys = ["commit", "file", "name"]
    j = before.withColumnRenamed("code", "func_before").join(after.withColumnRenamed("code", "func_after"), keys).where("func_before <> func_after")
    j = j.withColumn("pair_key", F.sha1(F.concat("func_before", F.lit("\0"), "func_after").cast("binary")))
    first = j.groupBy("pair_key").agg(F.min(F.struct(*keys, "func_before", "func_after")).alias("b"))
    return first.select("pair_key", "b.*")


def fix_commits(log: DataFrame) -> DataFrame:
    """log(commit, subject, paths array) -> commits that cite a CVE id and touch C files: (commit, cves, paths)."""
    ids = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("subject", F.lit(r"(?i)CVE-\d{4}-\d{4,7}"), F.lit(0)), F.upper)))
    paths = F.filter("paths", lambda p: p.rlike(r"(?i)\.c$") & ~p.rlike(r"(?i)(^|/)(tests?|testing|examples?|docs?)/"))
    wanted = log.where(~F.col("subject").rlike(r"(?i)^(merge|revert)\b")).select("commit", ids.alias("cves"), paths.alias("paths"))
    return wanted.where((F.size("cves") > 0) & (F.size("paths") > 0))


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a file by its suffix: Parquet's schema, a delimited file's header, or the keys of JSON lines."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).columns
    if path.endswith((".csv", ".tsv")):
        return spark.read.option("header", "true").option("sep", "\t" if path.endswith(".tsv") else ",").csv(path).columns
    first = spark.read.text(path).where(F.col("value").rlike(r"\S")).limit(1).select(F.json_object_keys("value").alias("k")).collect()
    return list(first[0]["k"] or []) if first else []
