"""Results by content: what a function makes of a text is kept under the text's digest and the function's version.

    m = Memo(spark, path, version_of(slice_lines), "n_lines bigint, n_kept bigint")
    out = m.apply(functions, F.col("code"), make)

An anti join finds the texts that the table does not have; only these are computed, each
different text once, and appended.  The table outlives queries and applications; a failed
job leaves nothing in it, and texts that two jobs computed at a time count once.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import on_hadoop

DIGEST, TEXT = "memo_digest", "memo_text"


def version_of(*parts: Callable | str) -> str:
    """A name for what functions do: the digest of their source, and of strings such as parameters."""
    return hashlib.sha256("\0".join(p if isinstance(p, str) else inspect.getsource(p) for p in parts).encode()).hexdigest()[:16]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class Memo:
    def __init__(self, spark: SparkSession, path: str, version: str, schema: str) -> None:
        """schema: the columns of a result; another version is another table."""
        self.spark, self.path, self.schema = spark, f"{path.rstrip('/')}/{version}", schema
        at, fs = on_hadoop(spark, self.path)
        fs.mkdirs(at)

    def table(self) -> DataFrame:
        """(memo_digest, result columns): one row per text so far."""
        return self.spark.read.schema(f"{DIGEST} binary, {self.schema}").parquet(self.path).dropDuplicates([DIGEST])

    def fill(self, texts: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """Compute what the table does not have of texts(memo_digest, memo_text).

        make gets (memo_digest, memo_text), each different text once, and gives memo_digest
        and the result columns.
        """
        unseen = texts.where(F.col(TEXT).isNotNull()).join(self.table().select(DIGEST), DIGEST, "left_anti").groupBy(DIGEST).agg(F.first(TEXT).alias(TEXT))
        made = make(unseen)
        made.select(*self.table().columns).write.mode("append").parquet(self.path)

    def apply(self, df: DataFrame, text: Column, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """df with the result columns; null where the text is null."""
        keyed = df.withColumn(DIGEST, digest(text))
        self.fill(keyed.select(DIGEST, text.alias(TEXT)), make)
        return keyed.join(self.table(), DIGEST, "left").drop(DIGEST)
