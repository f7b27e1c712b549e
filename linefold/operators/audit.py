"""The audit of a source tree: functions, sinks, slices, reading order.

    python -m linefold.operators.audit PATH... [--features] [--show N] [--out FOLDER]
"""

from __future__ import annotations

import argparse
import sys
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_sources, write_jsonl
from . import code as code_ops


def _order(kept: Column, sinks: Column, n: Column) -> Column:
    """Slice lines by distance to the nearest sink, then the rest, in line order."""
    dist = lambda x: F.coalesce(F.array_min(F.transform(sinks, lambda s: F.abs(s - x))), n)
    first = F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(dist(x).alias("d"), x.alias("x")))), lambda s: s["x"])
    return F.concat(first, F.array_except(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), kept))


def audit_functions(functions: DataFrame, with_features: bool = False) -> DataFrame:
    """functions(path, name, line, code) -> file, function, start_line, n_lines, sinks, slice, order (1-based lines of the file), status."""
    f = functions.withColumn("s", code_ops.backward_slice()(F.col("code"))).withColumn("n", F.size(F.split(F.regexp_replace("code", r"\n$", ""), "\n")))
    shift = lambda a: F.transform(a, lambda x: x + F.col("line") + 1)
    out = f.select(
        F.col("path").alias("file"), F.col("name").alias("function"), (F.col("line") + 1).alias("start_line"), F.col("n").alias("n_lines"),
        shift(F.col("s.sinks")).alias("sinks"), shift(F.col("s.kept")).alias("slice"), shift(_order(F.col("s.kept"), F.col("s.sinks"), F.col("n"))).alias("order"), F.col("s.status").alias("status"),
        *([F.array_sort(F.array_distinct(F.transform(code_ops.line_features(F.col("code")), lambda x: x["feat"]))).alias("features")] if with_features else []),
    )
    return out


def audit(spark: SparkSession, paths: list[str], with_features: bool = False) -> DataFrame:
    files = reduce(DataFrame.unionByName, [read_sources(spark, p).select("path", "content") for p in paths])
    return audit_functions(code_ops.functions_of(files), with_features)


def fallback_rates(audited: DataFrame) -> DataFrame:
    """n, and shares of functions with sinks, with the last-statement fallback and kept whole."""
    share = lambda s: F.avg((F.col("status") == s).cast("double"))
    return audited.agg(F.count("*").alias("n"), share("matched").alias("matched"), share("fallback").alias("fallback"), share("whole").alias("whole"))


def throughput(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count_distinct("file").alias("files"), F.count("*").alias("functions"), F.sum("n_lines").alias("lines"), (F.sum(F.size("slice")) / F.sum("n_lines")).alias("kept_share"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("paths", nargs="+")
    p.add_argument("--features", action="store_true")
    p.add_argument("--show", type=int, default=20)
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("linefold-audit").getOrCreate()
    began = time.time()
    df = audit(spark, a.paths, a.features)
    if a.out:
        write_jsonl(df, a.out)
        df = spark.read.json(a.out)
    else:
        df.show(a.show, truncate=80)
    r = throughput(df).collect()[0]
    print(f"{r.files} files, {r.functions} functions, {r.lines} lines, kept {r.kept_share or 0:.3f}, {r.functions / max(1e-9, time.time() - began):.0f} functions/s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
