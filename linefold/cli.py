"""Command lines over the queries and operators.

    python -m linefold.cli list
    python -m linefold.cli run QUERY... --data FOLDER [--out FOLDER] [--show N]
    python -m linefold.cli mine REPOSITORY... [--out FOLDER]
    python -m linefold.cli folds --data FOLDER [--group COLUMN] [--folds N]
    python -m linefold.cli embed --data FOLDER --out FOLDER
    python -m linefold.cli probe --data FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.documents import console_table


def _session() -> SparkSession:
    return SparkSession.builder.appName("linefold").getOrCreate()


def _done(df: DataFrame, name: str, a: argparse.Namespace) -> None:
    """Write a result where a folder is given, and show its first rows."""
    if a.out:
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        df = df.sparkSession.read.parquet(f"{a.out}/{name}")
    print(f"# {name}\n{console_table(df, most=a.show)}\n")


def _folds(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import folds

    d = spark.read.parquet(f"{a.data}/documents.parquet").join(spark.read.parquet(f"{a.data}/labels.parquet"), "doc_id").select("doc_id", F.col(a.group), "quality")
    f = folds.stratified_group_folds(d, a.group, "quality", a.folds)
    _done(f.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct(a.group).alias("groups"), F.count_if(F.col("quality") == 1).alias("positive")).orderBy("fold"), "folds", a)


def _embed(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import embeddings

    _done(embeddings.embed(spark.read.parquet(f"{a.data}/documents.parquet"), embeddings.hashed_encoder), "embeddings", a)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "run", "mine", "folds", "embed", "probe"):
        c = sub.add_parser(name)
        if name in ("run", "mine"):
            c.add_argument("names", nargs="+")
        if name not in ("list", "mine"):
            c.add_argument("--data", required=True)
        if name == "folds":
            c.add_argument("--group", default="source")
            c.add_argument("--folds", type=int, default=5)
        c.add_argument("--out")
        c.add_argument("--show", type=int, default=20)
    a = p.parse_args(argv)
    from .plans import catalogue

    if a.command == "list":
        for name, f in sorted(catalogue.QUERIES.items()):
            print(name, "-", (f.__doc__ or "").split("\n")[0])
        return 0
    if a.command == "run":
        unknown = [n for n in a.names if n not in catalogue.QUERIES]
        if unknown:
            print(f"no query {', '.join(unknown)}", file=sys.stderr)
            return 2
    spark = _session()
    if a.command == "run":
        for n in a.names:
            _done(catalogue.QUERIES[n](spark, a.data), n, a)
    elif a.command == "mine":
        from .sources import git_history

        spark.dataSource.register(git_history.GitHistory)
        for repo in a.names:
            _done(spark.read.format("git_history").option("path", repo).load(), repo.rstrip("/").rsplit("/", 1)[-1], a)
    elif a.command == "folds":
        _folds(spark, a)
    elif a.command == "embed":
        _embed(spark, a)
    else:
        _done(catalogue.QUERIES["fusion_cv"](spark, a.data), "probe", a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
