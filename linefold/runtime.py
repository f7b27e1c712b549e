"""Session helpers shared by the operators: shipping the package and shared folders."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWNED: set[str] = set()
_SCOPES: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as a small zip."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    folder = tempfile.mkdtemp(prefix="linefold-ship-")
    path = os.path.join(folder, "linefold_pkg.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent (tests, local mode) one is made under the temp folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"linefold-shared-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    return own


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/linefold/{app}"
    if app not in _OWNED:
        at, fs = on_hadoop(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _OWNED.add(app)
    return path


def on_hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that still read them become unreadable."""
    discard(spark, own_dir(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a table; see Scope."""
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for s in _SCOPES:
        s.append(path)
    return path


def append(df: DataFrame, path: str) -> DataFrame:
    """Add the rows of df to the table at path, which may be new; gives the table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all slots of the cluster where its files make fewer parts: a large table, which has more, is left as it is."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage durably."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As materialize(), and the path, for discard()."""
    path = new_path(df.sparkSession, name)
    return append(df, path), path


class Scope:
    """The tables written in a block, so that they can go together once their result stands.

    with Scope(spark) as s:
        out, path = materialize_at(work(...), "out")
    s.discard(but=path)
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        _SCOPES.append(self.paths)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPES[:] = [s for s in _SCOPES if s is not self.paths]

    def discard(self, but: str = "") -> None:
        discard(self.spark, *(p for p in self.paths if p != but))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for p in paths:
        at, fs = on_hadoop(spark, p)
        fs.delete(at, True)
