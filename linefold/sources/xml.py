"""XML files of units: one element per row, attributes as columns with a leading _, text as _VALUE."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_units(df: DataFrame, path: str, tag: str = "unit", root: str = "units") -> None:
    df.write.format("xml").option("rowTag", tag).option("rootTag", root).option("valueTag", "_VALUE").save(path)


def read_units(spark: SparkSession, path: str, schema: str, tag: str = "unit", keep_broken: bool = False) -> DataFrame:
    """The elements ``tag`` of all files at path, by a given schema, so that nothing is inferred.

    The XML source reads a file of elements over several lines in one task.  Here a file is
    cut at the closing tags by the text source, whose tasks share a large file, and each
    unit is parsed on its own.  Units do not stand inside each other and have a closing tag.
    A unit that is not well formed is left out, or with keep_broken becomes a row of nulls
    with its text in _corrupt_record.
    """
    opens = rf"(?s)(<{re.escape(tag)}[\s>].*)"
    cut = spark.read.option("lineSep", f"</{tag}>").text(path).where(F.col("value").rlike(opens))
    text = F.concat(F.regexp_extract("value", opens, 1), F.lit(f"</{tag}>"))
    options = {"rowTag": tag, "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = cut.select(F.from_xml(text, f"{schema}, _corrupt_record string", options).alias("u")).select("u.*")
    return read if keep_broken else read.where("_corrupt_record IS NULL").drop("_corrupt_record")
